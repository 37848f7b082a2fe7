"""The registered queries: they map the given tables to the operators' records and the results back."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm import (
    archive, filter_audit, language, lattice_dedup, ordinal, packing, piece_codec, pivot_search, ranked_search, shingle_join, token_counts,
    token_files, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- fixed values: rules of the URL query ------------------------------------------------------
URL_RULES = [("denylist", "net/"), ("allowlist", "example.net/en/"), ("denylist", "example.com/de/"), ("allowlist", "org/fr/")]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_url_filter", r"""
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
       ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path FROM pages)
SELECT page_id, u.host, u.path, r.host || r.path AS "rule", coalesce(r.verdict, 'allow') verdict
FROM u LEFT JOIN LATERAL (SELECT * FROM rules q WHERE (u.host = q.host OR ends_with(u.host, '.' || q.host))
     AND starts_with(u.path, q.path) ORDER BY length(q.host || q.path) DESC LIMIT 1) r ON true""")
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "type string, pattern string")
    boxes = table(spark, sf_dir, "pages").select(F.col("page_id").alias("frame_idx"), F.col("url").alias("text"))
    return url_filter.url_verdicts(boxes, rules).withColumnRenamed("frame_idx", "page_id")


def review_statuses(labels: DataFrame) -> DataFrame:
    """Reviews from the ratings: poor texts are rejected, good but toxic ones pending, good ones accepted."""
    return labels.select(
        F.col("doc_id").alias("event_id"),
        F.when(F.col("quality") == 0, "rejected").when((F.col("quality") == 1) & (F.col("toxic") == 1), "pending")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").alias("status"),
    )


def carried(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """doc_id and text under the operator's names, the other columns as one struct, so that no names clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), F.col("doc_id").alias(ident), F.col("text").alias(text))


def restored(docs: DataFrame, text: str) -> list[Column]:
    """The columns of docs out of what `carried` made."""
    return [F.col(text).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, carried and rated."""
    found = carried(docs, "event_id", "extracted_text")
    model = ordinal.fit_ratings(found, review_statuses(table(spark, sf_dir, "labels")))
    return ordinal.rate_findings(found, model)


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(spark, docs, sf_dir).select(F.col("event_id").alias("doc_id"), "expected_grade", "tail_probability", "selected")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("frame_idx").cast("string")), F.lit(4)) == 2


def languages(docs: DataFrame) -> DataFrame:
    """All rows of docs, carried, with lang_pred, score and narrow; learned from the rows that are not held out."""
    found = carried(docs, "frame_idx", "composite")
    learned = language.learn_languages(found.where(~held_out()).select("frame_idx", "composite", "row.lang"))
    return language.recognise_languages(found, learned)


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return languages(docs).select(
        F.col("frame_idx").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score", "narrow"
    )


@query("op10_warc", r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b, sha1(coalesce(html, '')) h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) first_id,
        list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substring(h, i, 1))::INT), 4, '0')), 'string_agg', '') bits FROM p)
SELECT page_id, octet_length(b) payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(1, 6), lambda j: substring(bits, 5 * i + j, 1)::INT * (16 >> (j - 1)::INT)))::INT, 1)), 'string_agg', '') payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END record_type,
       CASE WHEN page_id > first_id THEN first_id END refers_to FROM d""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    reports = pages.select(F.col("page_id").alias("project_id"), F.col("url").alias("uri"), "html")
    return archive.archive_reports(reports).select(
        F.col("project_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op7_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: hash(array_to_string(ws[i:i + 4], ' '))))
    WHEN len(ws) > 0 THEN [hash(array_to_string(ws, ' '))] ELSE [] END sh FROM w),
e AS (SELECT doc_id, len(sh) n, unnest(sh) h FROM s),
l AS (SELECT a.doc_id a, b.doc_id b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id node, doc_id reached FROM documents
    UNION SELECT r.node, x.t FROM r JOIN (SELECT a f, b t FROM l UNION ALL SELECT b, a FROM l) x ON x.f = r.reached)
SELECT s.doc_id, len(sh)::BIGINT n_shingles, (SELECT min(reached) FROM r WHERE r.node = s.doc_id) component_id FROM s""")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frame_texts(table(spark, sf_dir, "documents"))
    return shingle_join.similar_frames(frames).withColumnRenamed("frame_idx", "doc_id")


def frame_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("frame_idx"), F.col("text").alias("composite"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frame_texts(table(spark, sf_dir, "documents"))
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_files.tokenised_frames(frames, vocabulary, "words", 1).withColumnRenamed("frame_idx", "doc_id")


def pack(docs: DataFrame) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_frames(frame_texts(docs), vocabulary, "bytes", 0)
    return packed.withColumnsRenamed({"frame_idx": "doc_id", "frame_tokens": "doc_tokens"})


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def frame_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_idx"), F.col("embedding").alias("hist"))


@query("op1_exact_top_k", r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) z FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS (SELECT q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.z, c.z), lambda t: t[1] * t[2]))::BIGINT score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT "rank", vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frame_vectors(spark, sf_dir)
    return pivot_search.nearest_frames(frames, frames.where("frame_idx % 50 = 0")).withColumnRenamed("frame_idx", "vec_id")


@query("op2_embedding_near_dedup", r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id a, b.vec_id b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id node, vec_id reached FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) n_links, (SELECT min(reached) FROM r WHERE node = vec_id) component_id,
       vec_id = (SELECT min(reached) FROM r WHERE node = vec_id) kept FROM embeddings""")
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_copies(frame_vectors(spark, sf_dir)).withColumnRenamed("frame_idx", "vec_id")


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and a checksum of the text that decoding gives back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode_frames(frame_texts(table(spark, sf_dir, "documents")), model, decoded=True)
    return encoded.select(F.col("frame_idx").alias("doc_id"), "n_pieces", "ids_crc32", "text_crc32")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """Documents as frames of the video that their source names."""
    return docs.select(F.col("source").alias("video_id"), F.col("doc_id").alias("frame_idx"), F.col("text").alias("composite"))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = keyed_texts(table(spark, sf_dir, "documents"))
    counted = token_counts.frame_token_counts(frames, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(F.col("frame_idx").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


@query("op12_filter_audit", r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents),
f AS (SELECT w.doc_id, part, (len(ws) < 50)::INT a, (100 * len(list_distinct(ws)) < 65 * len(ws))::INT b,
        (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT c, regexp_matches(t, '[#$%&*|]')::INT d,
        coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT e FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false))::INT q, bool_or(coalesce(toxic = 1, false))::INT x FROM labels GROUP BY 1),
g AS (SELECT part, a, b, c, d, e, count(*) n, sum(coalesce(q, 0)) q, sum(coalesce(x, 0)) x FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || z FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(z) WHERE NOT contains(filter_order, z)),
s AS (SELECT filter_order, step, substring(filter_order, step, 1) z, substring(filter_order, 1, step - 1) prior
        FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
h AS (SELECT part, n, q, x, concat(repeat('A', a), repeat('B', b), repeat('C', c), repeat('D', d), repeat('E', e)) failed FROM g),
m AS (SELECT part, filter_order, step::INT step, z, n, q, x, failed, contains(failed, z) own,
        len(list_intersect(string_split(failed, ''), string_split(prior, ''))) > 0 AND failed <> '' AND prior <> '' earlier FROM h, s),
k AS (SELECT part, filter_order, step, z, sum(n) FILTER (NOT own AND NOT earlier) kept, sum(n) FILTER (own AND NOT earlier) removed,
        sum(n) FILTER (own AND earlier) redundant, sum(n) FILTER (failed = z) unique_fails,
        sum(q) FILTER (own AND NOT earlier) good_lost, sum(x) FILTER (own AND NOT earlier) toxic_lost FROM m GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT kept, coalesce(removed, 0)::BIGINT removed, coalesce(redundant, 0)::BIGINT redundant,
       coalesce(unique_fails, 0)::BIGINT unique_fails, coalesce(good_lost, 0)::BIGINT good_lost, coalesce(toxic_lost, 0)::BIGINT toxic_lost,
       sum(coalesce(removed, 0)) OVER (PARTITION BY part, z)::BIGINT shapley FROM k""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    findings = docs.select(F.col("doc_id").alias("event_id"), F.col("source").alias("project_id"), F.col("text").alias("extracted_text"))
    said = F.array(F.when(F.col("quality") == 1, "accepted"), F.when(F.col("toxic") == 1, "rejected"))
    reviewed = labels.select(F.col("doc_id").alias("event_id"), F.explode(said).alias("status")).where("status IS NOT NULL")
    return filter_audit.audit_filters(findings, reviewed).withColumnsRenamed(
        {"project_id": "part", "accepted_lost": "good_lost", "rejected_lost": "toxic_lost"}
    )


@query("op13_ranked_search", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ws FROM documents),
c AS (SELECT count(*) FILTER (len(ws) > 0) nn, sum(len(ws))::BIGINT ll FROM t),
f AS (SELECT doc_id, n, w, count(*) tf FROM (SELECT doc_id, len(ws) n, unnest(ws) w FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) w FROM benchmark),
d AS (SELECT w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT weight FROM f, c GROUP BY w, nn),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT score
    FROM q JOIN f USING (w) JOIN d USING (w), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT "rank", doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("event_id"), F.col("text").alias("extracted_text"))
    found = ranked_search.rank_frames(findings, keyed_texts(table(spark, sf_dir, "documents")))
    return found.select(F.col("event_id").alias("item_id"), "rank", F.col("frame_idx").alias("doc_id"), "score")
