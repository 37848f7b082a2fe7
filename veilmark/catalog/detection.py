"""Queries on boxes, sampling and classification."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.catalog.base import query, sql
from veilmark.functions import geometry as geo
from veilmark.functions.numeric import frame_to_ms, ms_to_frame, usable_fps
from veilmark.operators import boxes as ob
from veilmark.operators import classify as oc
from veilmark.operators import sampling as os_
from veilmark.operators import terms
from veilmark.schemas import DEFAULT_OVERRIDES, DEFAULT_THRESHOLD
from veilmark.sources import adapters as ad
from veilmark.sources.rules import BUILTIN, builtin_rules, make_rule

BOX = ["video_id", "frame_idx", "box_ord"]


def flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, "bbox.x", "bbox.y", "bbox.w", "bbox.h")


# ---- boxes -----------------------------------------------------------------------------------

@query("box_filter", sql("boxes", """
SELECT video_id, frame_idx, box_ord, text, confidence, x, y, w, h FROM boxes
WHERE confidence >= 0.25 AND length(text) > 0"""))
def box_filter(spark: SparkSession, d: str) -> DataFrame:
    return flat(ob.filter_boxes(ad.boxes(spark, d)), *BOX, "text", "confidence")


@query("box_rescale", sql("boxes", """
SELECT video_id, frame_idx, box_ord, trunc(x / 1.5::DOUBLE)::INT x, trunc(y / 1.5::DOUBLE)::INT y,
       trunc(w / 1.5::DOUBLE)::INT w, trunc(h / 1.5::DOUBLE)::INT h FROM boxes"""))
def box_rescale(spark: SparkSession, d: str) -> DataFrame:
    return flat(ob.rescale_boxes(ad.boxes(spark, d), 1.5), *BOX)


@query("box_output_scale", sql("boxes", """
SELECT video_id, frame_idx, box_ord, trunc(x * 0.75::DOUBLE)::INT x, trunc(y * 1.25::DOUBLE)::INT y,
       trunc(w * 0.75::DOUBLE)::INT w, trunc(h * 1.25::DOUBLE)::INT h,
       trunc((x + w) * 0.75::DOUBLE)::INT px, trunc((y + h) * 1.25::DOUBLE)::INT py FROM boxes"""))
def box_output_scale(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    drawn = ad.boxes(spark, d).withColumn("polygon", F.array(
        F.array(b["x"], b["y"]), F.array(b["x"] + b["w"], b["y"]), F.array(b["x"] + b["w"], b["y"] + b["h"])
    ))
    out = ob.scale_to_output(drawn, F.lit(0.75), F.lit(1.25))
    return out.select(*BOX, "bbox.x", "bbox.y", "bbox.w", "bbox.h",
                      F.col("polygon")[2][0].alias("px"), F.col("polygon")[2][1].alias("py"))


@query("polygon_bbox", sql("boxes", """
SELECT video_id, frame_idx, box_ord, x - 2 x, y - 1 y, w + 5 + 1 w, h + 5 + 1 h, w + 5 w_open, h + 5 h_open
FROM boxes"""))
def polygon_bbox(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bbox")
    right, low = b["x"] + b["w"], b["y"] + b["h"]
    drawn = ad.boxes(spark, d).withColumn("polygon", F.array(
        F.array(b["x"], b["y"] - 1), F.array(right + 3, b["y"]), F.array(right, low + 4), F.array(b["x"] - 2, low)
    ))
    both = ob.polygons_to_boxes(drawn).withColumn("open_box", geo.polygon_box(F.col("polygon"), False))
    return both.select(*BOX, "bbox.x", "bbox.y", "bbox.w", "bbox.h", F.col("open_box.w").alias("w_open"),
                       F.col("open_box.h").alias("h_open"))


@query("sparse_retry", sql("boxes", """
SELECT video_id, frame_idx, box_ord, text FROM boxes WHERE box_ord % 2 = 0
UNION ALL
SELECT r.video_id, r.frame_idx, r.box_ord, r.text FROM boxes r
WHERE r.box_ord % 2 = 1
  AND (SELECT count(*) FROM boxes b WHERE b.box_ord % 2 = 0 AND b.video_id = r.video_id
       AND b.frame_idx = r.frame_idx) < 5
  AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.box_ord % 2 = 0 AND b.video_id = r.video_id
       AND b.frame_idx = r.frame_idx AND lower(b.text) = lower(r.text))"""))
def sparse_retry(spark: SparkSession, d: str) -> DataFrame:
    b = ad.boxes(spark, d)
    return ob.sparse_retry_union(b.filter("box_ord % 2 = 0"), b.filter("box_ord % 2 = 1")).select(*BOX, "text")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return ad.hists(spark, d).select(
        "video_id", "frame_idx", F.expr("pmod(frame_idx, 100) / 100D").alias("confidence"),
        (F.col("hist")[0] - 0.05).alias("x1"), (F.col("hist")[1] - 0.05).alias("y1"),
        (F.col("hist")[0] + F.col("hist")[2] * 5).alias("x2"), (F.col("hist")[1] + F.col("hist")[3] * 5).alias("y2"),
    )


_PIXELS = """
SELECT video_id, frame_idx, confidence, greatest(0, trunc(x1 * 1920)::INT) x, greatest(0, trunc(y1 * 1080)::INT) y,
  least(1920, trunc(x2 * 1920)::INT) - greatest(0, trunc(x1 * 1920)::INT) w,
  least(1080, trunc(y2 * 1080)::INT) - greatest(0, trunc(y1 * 1080)::INT) h
FROM (SELECT video_id, frame_idx, (frame_idx % 100) / 100::DOUBLE confidence, hist[1] - 0.05::DOUBLE x1,
        hist[2] - 0.05::DOUBLE y1, hist[1] + hist[3] * 5 x2, hist[2] + hist[4] * 5 y2 FROM hists)"""


@query("detections_to_pixels", sql("hists", f"""
SELECT * FROM ({_PIXELS}) WHERE confidence >= 0.4::DOUBLE AND w >= 10 AND h >= 10"""))
def detections_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    limit = F.lit(ob.face_threshold(DEFAULT_OVERRIDES))
    return flat(ob.detections_to_pixels(_detections(spark, d), F.lit(1920), F.lit(1080), limit),
                "video_id", "frame_idx", "confidence")


def faces(spark: SparkSession, d: str) -> DataFrame:
    found = ob.detections_to_pixels(
        _detections(spark, d), F.lit(1920), F.lit(1080), F.lit(ob.face_threshold(None, DEFAULT_THRESHOLD))
    ).withColumn("face_ord", F.lit(0))
    return ob.face_candidates(ob.with_frame_time(found, F.lit(None).cast("double")))


@query("face_candidates", sql("hists", f"""
SELECT video_id, frame_idx, trunc(frame_idx / 30::DOUBLE * 1000)::INT time_ms, 'face' pii_type, '[face]' text,
       confidence, x, y, w, h FROM ({_PIXELS}) WHERE confidence >= 0.35::DOUBLE AND w >= 10 AND h >= 10"""))
def face_candidates(spark: SparkSession, d: str) -> DataFrame:
    return flat(faces(spark, d), "video_id", "frame_idx", "time_ms", "pii_type", "text", "confidence")


@query("frame_times", sql("boxes", """
SELECT video_id, frame_idx, ms, trunc(ms / 1000::DOUBLE * fps)::INT back_frame
FROM (SELECT *, trunc(frame_idx / fps * 1000)::INT ms FROM (
  SELECT DISTINCT video_id, frame_idx, CASE WHEN frame_idx % 3 = 0 THEN 30::DOUBLE ELSE 29.97::DOUBLE END fps
  FROM boxes))"""))
def frame_times(spark: SparkSession, d: str) -> DataFrame:
    fps = usable_fps(F.expr("CASE WHEN frame_idx % 3 = 0 THEN 0D ELSE 29.97D END"))
    frames = ad.boxes(spark, d).select("video_id", "frame_idx").distinct()
    ms = frame_to_ms(F.col("frame_idx"), fps)
    return frames.withColumn("ms", ms).withColumn("back_frame", ms_to_frame(F.col("ms"), fps))


# ---- sampling --------------------------------------------------------------------------------

def _frames(spark: SparkSession, d: str) -> DataFrame:
    return ad.boxes(spark, d).select("video_id", "frame_idx").distinct()


@query("sample_fixed", sql("boxes", """
SELECT DISTINCT video_id, frame_idx FROM boxes WHERE frame_idx % 3 = 0"""))
def sample_fixed(spark: SparkSession, d: str) -> DataFrame:
    return os_.sample_fixed(_frames(spark, d), 3)


@query("sample_range", sql("boxes", """
SELECT DISTINCT video_id, frame_idx FROM boxes WHERE frame_idx BETWEEN 60 AND 750"""))
def sample_range(spark: SparkSession, d: str) -> DataFrame:
    return os_.sample_range(_frames(spark, d), 2000, 25_000, 30.0)


@query("estimate_samples", sql("boxes", """
SELECT video_id, count(DISTINCT frame_idx) total_frames, greatest(1, count(DISTINCT frame_idx) // 3)::INT
  estimated_samples FROM boxes GROUP BY ALL"""))
def estimate_samples(spark: SparkSession, d: str) -> DataFrame:
    videos = _frames(spark, d).groupBy("video_id").agg(F.count("*").alias("total_frames"))
    return os_.estimated_samples(videos, 3)


@query("intensity_histogram", """
WITH b AS (SELECT user_id::VARCHAR video_id, floor((value - 0) * (16 / 256::DOUBLE))::INT slot, count(*) n
           FROM events GROUP BY ALL),
u AS (SELECT video_id, sqrt(sum(CASE WHEN slot BETWEEN 0 AND 15 THEN n * n ELSE 0 END)) norm FROM b GROUP BY ALL)
SELECT u.video_id, s.slot::INT slot, round(CASE WHEN norm > 0 THEN coalesce(b.n, 0) / norm ELSE 0 END, 9) value
FROM u CROSS JOIN range(0, 16) s(slot) LEFT JOIN b ON b.video_id = u.video_id AND b.slot = s.slot""")
def intensity_histogram(spark: SparkSession, d: str) -> DataFrame:
    values = ad.table(spark, d, "events").select(F.col("user_id").cast("string").alias("video_id"), "value")
    hist = os_.intensity_histogram(values, ["video_id"], "value", 16)
    return hist.select("video_id", F.posexplode("hist").alias("slot", "value")).withColumn(
        "value", F.round("value", 9)
    )


_PAIRS = """
SELECT video_id, lag(frame_idx) OVER w prev_frame, frame_idx, lag(hist) OVER w prev, hist FROM hists
WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)"""
_DIST = """sqrt(greatest(0, 1 - list_sum(list_transform(range(1, 65), lambda i: sqrt({a}[i] * {b}[i])))
  / sqrt(list_sum({a}) * list_sum({b}))))"""
_MAD = "list_sum(list_transform(range(1, 65), lambda i: abs({a}[i] - {b}[i]))) / 64"


@query("scene_changes", sql("hists", f"""
SELECT video_id, prev_frame, frame_idx, round(dist, 9) distance FROM (
  SELECT *, {_DIST.format(a='prev', b='hist')} dist FROM ({_PAIRS}) WHERE prev IS NOT NULL) WHERE dist > 0.4"""))
def scene_changes(spark: SparkSession, d: str) -> DataFrame:
    return os_.scene_changes(ad.hists(spark, d), 0.40, 64).withColumn("distance", F.round("distance", 9))


@query("motion_mad", sql("hists", f"""
SELECT video_id, prev_frame, frame_idx, round(mad, 9) mad FROM (
  SELECT *, {_MAD.format(a='prev', b='hist')} mad FROM ({_PAIRS}) WHERE prev IS NOT NULL) WHERE mad >= 0.1"""))
def motion_mad(spark: SparkSession, d: str) -> DataFrame:
    return os_.motion(ad.hists(spark, d), 0.1, chunk_frames=64).withColumn("mad", F.round("mad", 9))


@query("scene_cut_times", sql("hists", f"""
SELECT video_id, (trunc(prev_frame / 30::DOUBLE * 1000)::BIGINT + trunc(frame_idx / 30::DOUBLE * 1000)::BIGINT) // 2
  cut_ms FROM (SELECT *, {_DIST.format(a='prev', b='hist')} dist FROM ({_PAIRS}) WHERE prev IS NOT NULL)
WHERE dist > 0.4"""))
def scene_cut_times(spark: SparkSession, d: str) -> DataFrame:
    return os_.scene_cut_times(os_.scene_changes(ad.hists(spark, d), 0.40, 64), F.lit(30.0))


def dense_hists(spark: SparkSession, d: str) -> DataFrame:
    """Histograms with frames numbered from 0 in each video."""
    from veilmark.plans.ordered import chunk_by, ranked

    placed = ranked(ad.hists(spark, d), ["video_id"], ["frame_idx"], "rn", chunk_by("frame_idx", 512))
    return placed.select("video_id", (F.col("rn") - 1).cast("int").alias("frame_idx"), "hist")


@query("adaptive_sample", sql("hists", """
SELECT video_id, f::INT frame_idx, p::INT prev_frame, scene, burst::INT burst FROM walk""", {
    "dense": """SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 f, hist,
      count(*) OVER (PARTITION BY video_id) n FROM hists""",
    "walk": f"""
SELECT video_id, 0::BIGINT f, NULL::BIGINT p, false scene, 0 burst FROM dense WHERE f = 0
UNION ALL
SELECT video_id, f, p, scene,
  CASE WHEN scene THEN 8 WHEN left_over = 0 AND moved THEN 8 ELSE left_over END
FROM (SELECT s.video_id, c.f, s.f p, greatest(s.burst - 1, 0) left_over,
        {_DIST.format(a='q.hist', b='c.hist')} > 0.42::DOUBLE scene,
        {_MAD.format(a='q.hist', b='c.hist')} >= 0.12::DOUBLE moved
      FROM walk s JOIN dense q ON q.video_id = s.video_id AND q.f = s.f
      JOIN dense c ON c.video_id = s.video_id
       AND c.f = least(q.n - 1, s.f + CASE WHEN s.burst > 0 THEN 2 ELSE 5 END) AND c.f > s.f)"""}))
def adaptive_sample(spark: SparkSession, d: str) -> DataFrame:
    return os_.adaptive_sample(dense_hists(spark, d), 5, 0.42, 0.12, chunk_frames=16)


# ---- analyzer spans --------------------------------------------------------------------------

@query("composite_texts", sql("composites", """
SELECT video_id, frame_idx, length(composite)::INT n_chars, sha256(composite) text_hash FROM composites"""))
def composite_texts(spark: SparkSession, d: str) -> DataFrame:
    return oc.composite_text(ad.boxes(spark, d)).select(
        *oc.FRAME, F.length("composite").alias("n_chars"), F.sha2("composite", 256).alias("text_hash")
    )


@query("composite_offsets", sql("offsets", """
SELECT video_id, frame_idx, box_ord, s start_at, (s + length(text))::INT end_at FROM offsets"""))
def composite_offsets(spark: SparkSession, d: str) -> DataFrame:
    return oc.box_offsets(ad.boxes(spark, d)).select(
        *BOX, F.col("start").alias("start_at"), F.col("end").alias("end_at")
    )


@query("span_attribution", sql("spans offsets", """
SELECT p.video_id, p.frame_idx, p.span_ord, min(o.box_ord) box_ord FROM spans p JOIN offsets o
  ON p.video_id = o.video_id AND p.frame_idx = o.frame_idx AND p.s < o.s + length(o.text) AND p.e > o.s
GROUP BY ALL"""))
def span_attribution(spark: SparkSession, d: str) -> DataFrame:
    return oc.span_to_box(ad.spans(spark, d), ad.boxes(spark, d)).select(*oc.FRAME, "span_ord", "box_ord")


@query("entity_types", sql("spans entity_map", """
SELECT video_id, m.pii_type, count(*) n FROM spans JOIN entity_map m USING (entity_type) GROUP BY ALL"""))
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    mapped = ad.spans(spark, d).withColumn("pii_type", oc.mapped_type(F.col("entity_type")))
    return mapped.filter("pii_type IS NOT NULL").groupBy("video_id", "pii_type").agg(F.count("*").alias("n"))


@query("span_thresholds", sql("spans entity_map limits", """
SELECT video_id, frame_idx, span_ord, m.pii_type, score FROM spans JOIN entity_map m USING (entity_type)
LEFT JOIN limits l USING (pii_type) WHERE score >= coalesce(l.limit_value, 0.35::DOUBLE)"""))
def span_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return oc.kept_spans(ad.spans(spark, d), DEFAULT_THRESHOLD, DEFAULT_OVERRIDES).select(
        *oc.FRAME, "span_ord", "pii_type", "score"
    )


@query("analyzer_candidates", sql("analyzer", """
SELECT video_id, frame_idx, time_ms, span_ord, pii_type, confidence, text, x, y, w, h FROM analyzer"""))
def analyzer_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = oc.analyzer_candidates(ad.spans(spark, d), ad.boxes(spark, d), DEFAULT_THRESHOLD, DEFAULT_OVERRIDES)
    return flat(found.withColumnRenamed("first_ord", "span_ord"), *oc.FRAME, "time_ms", "span_ord", "pii_type",
                "confidence", "text")


# RE2 has no lookahead: the address rule is stated without it and its three exceptions are filtered.
_IP = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
REGEX_RULES = [r for r in BUILTIN if r[2] == "regex"]


def oracle_pattern(rule: tuple) -> str:
    return "(?i)" + (_IP if rule[0] == "ipv4_address" else rule[3])


def oracle_text(text: str, rule: tuple) -> str:
    r"""RE2 knows ASCII word characters only. For rules without letters, letters of any script become
    underscores, so that \b falls where Unicode puts it; lengths stay."""
    if rule[0] in ("email", "url_credentials"):
        return text
    return rf"regexp_replace({text}, '\p{{L}}', '_', 'g')"


def oracle_hits(text: str, rule: tuple) -> str:
    found = f"regexp_extract_all({oracle_text(text, rule)}, '{oracle_pattern(rule)}')"
    if rule[0] == "ipv4_address":
        return f"list_filter({found}, lambda m: m NOT IN ('127.0.0.1', '0.0.0.0', '255.255.255.255'))"
    return found


def oracle_spans(table: str, key: str, text: str, rules: list[tuple]) -> str:
    """Positions of all matches: the pieces between them give the offsets."""
    parts = []
    for i, rule in enumerate(rules):
        pattern = oracle_pattern(rule)
        parts.append(f"""
SELECT {key}, '{rule[0]}' rule_id, {i} rule_ord, p.k hit_no, m[p.k] hit,
  (list_sum(list_transform(g[1:p.k], lambda v: length(v)))
   + coalesce(list_sum(list_transform(m[1:p.k-1], lambda v: length(v))), 0))::INT s
FROM (SELECT {key}, regexp_extract_all(t, '{pattern}') m, string_split_regex(t, '{pattern}') g
      FROM (SELECT {key}, {oracle_text(text, rule)} t FROM {table})), LATERAL (SELECT unnest(range(1, len(m) + 1)) k) p""")
    return "SELECT *, (s + length(hit))::INT e FROM (" + " UNION ALL ".join(parts) + (
        ") WHERE rule_id <> 'ipv4_address' OR hit NOT IN ('127.0.0.1', '0.0.0.0', '255.255.255.255')"
    )


_RECOGNISED = [r for r in REGEX_RULES if r[0] in (
    "phone_us", "email", "ssn", "credit_card", "ipv4_address", "bank_account_us")]
_ENTITY = """CASE rule_id WHEN 'phone_us' THEN 'PHONE_NUMBER' WHEN 'email' THEN 'EMAIL_ADDRESS'
 WHEN 'ssn' THEN 'US_SSN' WHEN 'credit_card' THEN 'CREDIT_CARD' WHEN 'ipv4_address' THEN 'IP_ADDRESS'
 ELSE 'US_BANK_NUMBER' END"""
_LUHN = """(SELECT sum(CASE WHEN i % 2 = 0 THEN v - CASE WHEN v > 9 THEN 9 ELSE 0 END ELSE v END) % 10 = 0
  FROM (SELECT i, CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END * substring(r, i::INT, 1)::INT v
        FROM (SELECT reverse(regexp_replace(hit, '[^0-9]', '', 'g')) r), LATERAL (SELECT unnest(range(1, length(r) + 1)) i)))"""


@query("recogniser_spans", sql("", f"""
SELECT doc_id, {_ENTITY} entity_type, s start_at, e end_at, hit FROM
({oracle_spans('documents', 'doc_id', 'text', _RECOGNISED)})"""))
def recogniser_spans(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    return oc.recogniser_spans(docs, "text", ["doc_id"]).select(
        "doc_id", "entity_type", F.col("start").alias("start_at"), F.col("end").alias("end_at"),
        F.col("text_hit").alias("hit"),
    )


@query("recogniser_counts", sql("", f"""
SELECT entity_type, count(*) n FROM (SELECT {_ENTITY} entity_type, hit FROM
({oracle_spans('documents', 'doc_id', 'text', _RECOGNISED)})
WHERE rule_id <> 'credit_card' OR {_LUHN}) GROUP BY ALL"""))
def recogniser_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    found = oc.recogniser_spans(docs, "text", ["doc_id"], checked_cards=True)
    return found.groupBy("entity_type").agg(F.count("*").alias("n"))


def _load_names():
    """A stand-in analyzer: capitalised words are persons."""
    import re

    word = re.compile(r"\b[A-Z][a-z]{3,}\b", re.ASCII)
    return lambda text: [("PERSON", m.start(), m.end(), 0.6) for m in word.finditer(text)]


@query("plugin_analyzer", sql("composites", r"""
SELECT video_id, frame_idx, count(*) n, sum(s)::BIGINT start_sum, sum(length(hit))::BIGINT length_sum FROM (
  SELECT video_id, frame_idx, p.k, m[p.k] hit, list_sum(list_transform(g[1:p.k], lambda v: length(v)))
    + coalesce(list_sum(list_transform(m[1:p.k - 1], lambda v: length(v))), 0) s
  FROM (SELECT video_id, frame_idx, regexp_extract_all(composite, '\b[A-Z][a-z]{3,}\b') m,
          string_split_regex(composite, '\b[A-Z][a-z]{3,}\b') g FROM composites),
    LATERAL (SELECT unnest(range(1, len(m) + 1)) k) p) GROUP BY ALL"""))
def plugin_analyzer(spark: SparkSession, d: str) -> DataFrame:
    found = oc.plugin_spans(oc.composite_text(ad.boxes(spark, d)), _load_names)
    return found.groupBy(*oc.FRAME).agg(
        F.count("*").alias("n"), F.sum("start").alias("start_sum"), F.sum(F.col("end") - F.col("start")).alias("length_sum")
    )


# ---- regex and label rules -------------------------------------------------------------------

def oracle_candidates(table: str) -> str:
    """All matches of the built-in regex rules on the boxes of a table."""
    parts = [f"""
SELECT video_id, frame_idx, time_ms, box_ord, x, y, w, h, {i} rule_ord, '{r[0]}' rule_id, '{r[4]}' pii_type,
       {r[6]}::DOUBLE confidence, unnest(m) text, unnest(range(0, len(m))) hit_no
FROM (SELECT *, {oracle_hits('text', r)} m FROM {table})""" for i, r in enumerate(REGEX_RULES)]
    return " UNION ALL ".join(parts)


_HITS = {"hits": oracle_candidates("boxes")}


def document_hits(spark: SparkSession, d: str) -> DataFrame:
    return oc.regex_candidates(ad.boxes(spark, d), builtin_rules())


@query("regex_rule_hits", sql("boxes", """
SELECT video_id, frame_idx, time_ms, box_ord, hit_no::INT hit_no, rule_id, pii_type, confidence, text, x, y, w, h
FROM hits""", _HITS))
def regex_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    found = document_hits(spark, d).withColumnsRenamed({"first_ord": "box_ord", "second_ord": "hit_no"})
    return flat(found, *oc.FRAME, "time_ms", "box_ord", "hit_no", "rule_id", "pii_type", "confidence", "text")


_OWN = [("email", "thin[a-z]*"), ("ssn", "aie[a-z]*"), ("mine", "@[a-z]+")]


@query("custom_rule_hits", sql("boxes", " UNION ALL ".join(f"""
SELECT video_id, frame_idx, box_ord, '{i}' rule_id, unnest(m) text, unnest(range(0, len(m)))::INT hit_no
FROM (SELECT *, regexp_extract_all(text, '(?i){p}') m FROM boxes)""" for i, p in _OWN)))
def custom_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """Rules of one's own, two of which have the id of a built-in one."""
    rules = [make_rule(i, p, "custom", rule_ord=k) for k, (i, p) in enumerate(_OWN)]
    return oc.regex_candidates(ad.boxes(spark, d), rules).select(
        *oc.FRAME, F.col("first_ord").alias("box_ord"), "rule_id", "text", F.col("second_ord").alias("hit_no"))


@query("regex_rule_counts", sql("boxes", """
SELECT video_id, pii_type, rule_id, count(*) findings FROM hits GROUP BY ALL""", _HITS))
def regex_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return document_hits(spark, d).groupBy("video_id", "pii_type", "rule_id").agg(F.count("*").alias("findings"))


@query("html_rule_hits", sql("page_boxes", """
SELECT frame_idx, box_ord, hit_no::INT hit_no, rule_id, pii_type, text FROM hits""",
                             {"hits": oracle_candidates("page_boxes")}))
def html_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    found = oc.regex_candidates(ad.page_boxes(spark, d), builtin_rules())
    return found.select("frame_idx", F.col("first_ord").alias("box_ord"), F.col("second_ord").alias("hit_no"),
                        "rule_id", "pii_type", "text")


def une_rule() -> dict:
    return make_rule("une", r"\bune\b", "person", type="field_label", confidence=0.8, context_pixels=20, rule_ord=100)


def the_rule() -> dict:
    return make_rule("the", r"\bthe\b", "address", type="context", confidence=0.8, context_pixels=60, rule_ord=101)


def oracle_labels(table: str, word: str, reach: int) -> str:
    return rf"""
SELECT v.video_id, v.frame_idx, v.x, v.y, v.w, v.h, min((l.box_ord, v.box_ord, v.text)) pick FROM {table} l
JOIN {table} v ON v.video_id = l.video_id AND v.frame_idx = l.frame_idx AND v.box_ord <> l.box_ord AND (
  (v.x >= l.x + l.w AND v.x <= l.x + l.w + {reach} AND v.y < l.y + l.h AND v.y + v.h > l.y) OR
  (v.y >= l.y + l.h AND v.y <= l.y + l.h + {reach} AND v.x < l.x + l.w AND v.x + v.w > l.x))
WHERE regexp_matches(l.text, '(?i)(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])') GROUP BY ALL"""


_PICKED = """
SELECT video_id, frame_idx, x, y, w, h, pick[1] label_ord, pick[2] box_ord,
       regexp_replace(pick[3], '^\\s+|\\s+$', '', 'g') text FROM picked"""


def _label_rows(found: DataFrame) -> DataFrame:
    return flat(found, *oc.FRAME, "text", "first_ord", "second_ord").withColumnsRenamed(
        {"first_ord": "label_ord", "second_ord": "box_ord"}
    )


@query("label_rule_below", sql("boxes", _PICKED, {"picked": oracle_labels("boxes", "une", 20)}))
def label_rule_below(spark: SparkSession, d: str) -> DataFrame:
    return _label_rows(oc.label_candidates(ad.boxes(spark, d), [une_rule()]))


@query("label_rule_right", sql("words", _PICKED, {"picked": oracle_labels("words", "the", 60)}))
def label_rule_right(spark: SparkSession, d: str) -> DataFrame:
    return _label_rows(oc.label_candidates(ad.words(spark, d), [the_rule()]))


# The given texts hold no captions, so some words are read as such: fixed values of the queries.
CAPTIONS = [("Une ", "Name: "), ("Der ", "Phone: "), ("And ", "Bank: "), ("Les ", "SSN: "), ("Por ", "E-mail: ")]
LABEL_RULES = [(i, r) for i, r in enumerate(BUILTIN) if r[2] == "field_label"]


def captioned(boxes: DataFrame) -> DataFrame:
    text = F.col("text")
    for word, caption in CAPTIONS:
        text = F.replace(text, F.lit(word), F.lit(caption))
    return boxes.withColumn("text", text)


def oracle_captioned(table: str) -> str:
    text = "text"
    for word, caption in CAPTIONS:
        text = f"replace({text}, '{word}', '{caption}')"
    return f"SELECT * REPLACE ({text} AS text) FROM {table}"


def oracle_builtin_labels(table: str) -> str:
    """One value per rectangle for the built-in label rules: the first rule, label and value box."""
    parts = []
    for i, r in LABEL_RULES:
        words = r[3].removeprefix(r"(?i)\b").removesuffix(r"\b")
        parts.append(oracle_labels(table, words, r[7]).replace(
            "min((l.box_ord, v.box_ord, v.text)) pick", f"min(({i}, l.box_ord, v.box_ord, v.time_ms, v.text)) pick"
        ))
    kind = " ".join(f"WHEN {i} THEN '{r[4]}'" for i, r in LABEL_RULES)
    sure = " ".join(f"WHEN {i} THEN {r[6]}::DOUBLE" for i, r in LABEL_RULES)
    return rf"""
SELECT video_id, frame_idx, x, y, w, h, p[1] rule_ord, p[2] label_ord, p[3] box_ord, p[4] time_ms, CASE p[1] {kind} END pii_type,
  CASE p[1] {sure} END confidence, regexp_replace(p[5], '^\s+|\s+$', '', 'g') text
FROM (SELECT video_id, frame_idx, x, y, w, h, min(pick) p FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL)"""


@query("label_rules_builtin", sql("boxes", """
SELECT video_id, frame_idx, x, y, w, h, rule_ord, label_ord, box_ord, time_ms, pii_type, confidence, text FROM labelled""", {
    "seen": oracle_captioned("boxes"), "labelled": oracle_builtin_labels("seen")}))
def label_rules_builtin(spark: SparkSession, d: str) -> DataFrame:
    found = oc.label_candidates(captioned(ad.boxes(spark, d)), builtin_rules(), None, DEFAULT_THRESHOLD, DEFAULT_OVERRIDES)
    return flat(found, *oc.FRAME, "rule_ord", "first_ord", "second_ord", "time_ms", "pii_type", "confidence", "text"
                ).withColumnsRenamed({"first_ord": "label_ord", "second_ord": "box_ord"})


@query("classify_all", sql("boxes analyzer", """
SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id, frame_idx
         ORDER BY src, rule_ord, o1, o2)::INT place, source, pii_type, text, x, y, w, h
FROM (SELECT 0 src, 'analyzer' source, video_id, frame_idx, 0 rule_ord, span_ord o1, 0 o2, pii_type, text, x, y, w, h
      FROM analyzer
      UNION ALL SELECT 1, 'regex', video_id, frame_idx, rule_ord, box_ord, hit_no, pii_type, text, x, y, w, h FROM hits
      UNION ALL SELECT 2, 'context', video_id, frame_idx, 100, pick[1], pick[2], 'person', pick[3], x, y, w, h
      FROM picked p WHERE NOT EXISTS (SELECT 1 FROM
        (SELECT video_id, frame_idx, x, y, w, h FROM hits UNION ALL
         SELECT video_id, frame_idx, x, y, w, h FROM analyzer) f
        WHERE f.video_id = p.video_id AND f.frame_idx = p.frame_idx AND f.x = p.x AND f.y = p.y AND f.w = p.w AND f.h = p.h))
""", {**_HITS, "picked": oracle_labels("boxes", "une", 20)}))
def classify_all(spark: SparkSession, d: str) -> DataFrame:
    rules = [r for r in builtin_rules() if r["type"] == "regex"] + [une_rule()]
    found = oc.classify(ad.boxes(spark, d), rules, ad.spans(spark, d), None, DEFAULT_THRESHOLD, DEFAULT_OVERRIDES)
    return found.select(
        *oc.FRAME, (F.col("cand_ord") - F.shiftleft(F.col("frame_idx").cast("long"), 24)).cast("int").alias("place"),
        "source", "pii_type", "text", "x", "y", "w", "h",
    )


@query("rule_sample_test", r"""
SELECT item_id, len(m)::INT match_count, array_to_string(m, '|') matches
FROM (SELECT item_id, regexp_extract_all(text, '\b([A-Z])[a-z]+', 1) m FROM benchmark)""")
def rule_sample_test(spark: SparkSession, d: str) -> DataFrame:
    tested = oc.rule_sample_test(ad.table(spark, d, "benchmark"), "text", r"\b([A-Z])[a-z]+")
    return tested.select("item_id", "match_count", F.array_join("matches", "|").alias("matches"))


_GROUPED = "([A-Z])([a-z]+)(,)?"


@query("rule_test_groups", f"""
SELECT doc_id, CASE WHEN length(text) > 10000 THEN 'text longer than 10000 characters' END error,
  CASE WHEN length(text) <= 10000 THEN len(a)::INT END match_count,
  CASE WHEN length(text) <= 10000 THEN md5(array_to_string(list_transform(range(1, len(a) + 1),
    lambda i: concat(a[i], '/', b[i], '/', coalesce(c[i], ''))), '|')) END matches
FROM (SELECT doc_id, text, regexp_extract_all(text, '{_GROUPED}', 1) a, regexp_extract_all(text, '{_GROUPED}', 2) b,
        regexp_extract_all(text, '{_GROUPED}', 3) c FROM documents)""")
def rule_test_groups(spark: SparkSession, d: str) -> DataFrame:
    tested = oc.rule_sample_test(ad.table(spark, d, "documents").select("doc_id", "text"), "text", _GROUPED)
    lines = F.transform("matches", lambda m: F.array_join(m, "/"))
    return tested.select("doc_id", "error", "match_count", F.md5(F.array_join(lines, "|")).alias("matches"))


@query("scan_diagnostics", sql("span_texts entity_map limits", """
SELECT video_id, frame_idx, span_ord, entity_type, text, score confidence, m.pii_type mapped_pii_type,
  CASE WHEN m.pii_type IS NULL THEN concat('entity type ''', entity_type, ''' not in type map')
       WHEN entity_type = 'PERSON' AND length(text) < 4
       THEN concat('PERSON too short (', length(text), ' < 4 chars)')
       WHEN score < coalesce(limit_value, 0.35::DOUBLE)
       THEN concat('confidence ', printf('%.2f', score), ' < threshold ', printf('%.2f', coalesce(limit_value, 0.35::DOUBLE)))
  END skip_reason
FROM span_texts LEFT JOIN entity_map m USING (entity_type) LEFT JOIN limits l USING (pii_type)"""))
def scan_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return oc.scan_diagnostics(
        ad.spans(spark, d), ad.boxes(spark, d), DEFAULT_THRESHOLD, DEFAULT_OVERRIDES
    ).select(*oc.FRAME, "span_ord", "entity_type", "text", "confidence", "mapped_pii_type", "skip_reason")


@query("diagnostic_counts", sql("span_texts entity_map limits", """
SELECT video_id, count(*) raw_count, count(*) FILTER (ok) kept_count, count(*) FILTER (NOT ok) filtered_count
FROM (SELECT video_id, m.pii_type IS NOT NULL AND NOT (entity_type = 'PERSON' AND length(text) < 4)
        AND score >= coalesce(limit_value, 0.35::DOUBLE) ok
      FROM span_texts LEFT JOIN entity_map m USING (entity_type) LEFT JOIN limits l USING (pii_type))
GROUP BY ALL"""))
def diagnostic_counts(spark: SparkSession, d: str) -> DataFrame:
    listed = oc.scan_diagnostics(ad.spans(spark, d), ad.boxes(spark, d), DEFAULT_THRESHOLD, DEFAULT_OVERRIDES)
    return oc.diagnostic_counts(listed, ["video_id"])


def numbered_hits(spark: SparkSession, d: str) -> DataFrame:
    """Regex candidates with their order number."""
    rules = [r for r in builtin_rules() if r["type"] == "regex"]
    return oc.classify(ad.boxes(spark, d), rules)


@query("single_frame_events", sql("boxes", """
SELECT video_id, frame_idx, pii_type, confidence, NULL::VARCHAR extracted_text, time_ms start_ms, time_ms end_ms,
       x, y, w, h, 'none' tracking_method, 'pending' status FROM hits""", _HITS))
def single_frame_events(spark: SparkSession, d: str) -> DataFrame:
    made = oc.single_frame_events(numbered_hits(spark, d), secure=True)
    return made.select("video_id", F.expr("CAST(start_ms / 500 AS INT)").alias("frame_idx"), "pii_type", "confidence",
                       "extracted_text", "start_ms", "end_ms", "x", "y", "w", "h", "tracking_method", "status")


@query("scan_preview", sql("boxes", """
SELECT video_id, frame_idx, findings, sum(findings) OVER (PARTITION BY video_id ORDER BY frame_idx)::BIGINT findings_so_far
FROM (SELECT video_id, frame_idx, count(*) findings FROM hits GROUP BY ALL)""", _HITS))
def scan_preview(spark: SparkSession, d: str) -> DataFrame:
    return oc.scan_preview(document_hits(spark, d), 256)


@query("preview_boxes", sql("boxes", """
SELECT video_id, frame_idx, pii_type, x, y, w, h FROM hits""", _HITS))
def preview_boxes(spark: SparkSession, d: str) -> DataFrame:
    return oc.preview_boxes(numbered_hits(spark, d)).drop("cand_ord")


# ---- lists, precedence and counters ----------------------------------------------------------

@query("allow_list", sql("boxes", """
SELECT h.video_id, h.frame_idx, h.text FROM hits h WHERE lower(h.text) NOT IN
  (SELECT lower(min(text)) FROM hits GROUP BY video_id)""", _HITS))
def allow_list(spark: SparkSession, d: str) -> DataFrame:
    hits = document_hits(spark, d)
    allowed = hits.groupBy("video_id").agg(F.min("text").alias("pattern"))
    return oc.allow_list(hits, allowed).select(*oc.FRAME, "text")


DENIED = ["the", "une", "nicht"]


@query("deny_list", sql("boxes", " UNION ALL ".join(
    f"SELECT video_id, frame_idx, box_ord, 'deny_{w}' rule_id FROM boxes WHERE contains(lower(text), '{w}')"
    for w in DENIED)))
def deny_list(spark: SparkSession, d: str) -> DataFrame:
    return oc.deny_list(ad.boxes(spark, d), _deny_rules()).select(*BOX, "rule_id")


# Phrases of three words as a list of terms that is a table.
_PHRASES = """
SELECT 'item_' || item_id || '_' || k rule_id, array_to_string(ws[k + 1:k + 3], ' ') pattern FROM (
  SELECT item_id, string_split(text, ' ') ws FROM benchmark) JOIN range(0, 1000) r(k) ON k <= len(ws) - 3"""


def phrase_rules(spark: SparkSession, d: str, kind: str) -> DataFrame:
    words = F.split("text", " ")
    phrases = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, k + 1, 3), " ").alias("pattern"))
    )
    return ad.table(spark, d, "benchmark").where(F.size(words) >= 3).select("item_id", F.explode(phrases).alias("p")).select(
        (F.col("item_id") * 1000 + F.col("p.k")).alias("rule_ord"), F.concat(F.lit("item_"), "item_id", F.lit("_"), "p.k").alias("rule_id"),
        F.lit(kind).alias("type"), F.lit(True).alias("enabled"), "p.pattern", F.lit("custom").alias("label"), F.lit(0.9).alias("confidence"),
    )


@query("deny_list_table", sql("boxes", """
SELECT video_id, frame_idx, box_ord, rule_id, 'custom' pii_type FROM boxes JOIN phrases ON contains(lower(text), lower(pattern))""", {"phrases": _PHRASES}))
def deny_list_table(spark: SparkSession, d: str) -> DataFrame:
    return terms.deny_list_table(ad.boxes(spark, d), phrase_rules(spark, d, "denylist")).select(*BOX, "rule_id", "pii_type")


@query("deny_table_counts", sql("boxes", """
SELECT rule_id, count(b.video_id) boxes, count(DISTINCT b.video_id) videos FROM phrases
LEFT JOIN boxes b ON contains(lower(text), lower(pattern)) GROUP BY rule_id""", {"phrases": _PHRASES}))
def deny_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """Where each listed phrase stands, those that stand nowhere too."""
    rules = phrase_rules(spark, d, "denylist")
    found = terms.deny_list_table(ad.boxes(spark, d), rules).groupBy("rule_id").agg(
        F.count("*").alias("boxes"), F.count_distinct("video_id").alias("videos")
    )
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rules.select("rule_id").distinct().join(found, "rule_id", "left").select("rule_id", none("boxes"), none("videos"))


@query("allow_list_table", sql("boxes", """
SELECT h.video_id, h.frame_idx, h.rule_id, h.text FROM hits h WHERE lower(h.text) NOT IN
  (SELECT lower(text) FROM hits GROUP BY lower(text) HAVING count(*) > 1)""", _HITS))
def allow_list_table(spark: SparkSession, d: str) -> DataFrame:
    """Hits but those whose text is found more than once, by a table of those texts."""
    hits = document_hits(spark, d)
    often = hits.groupBy(F.lower("text").alias("pattern")).count().where("count > 1")
    return terms.spared_by_table(hits, often.selectExpr("pattern", "'allowlist' AS type", "true AS enabled")).select(*oc.FRAME, "rule_id", "text")


def _deny_rules() -> list[dict]:
    return [make_rule(f"deny_{w}", w, "custom", type="denylist", rule_ord=i, priority=1) for i, w in enumerate(DENIED)]


@query("rule_precedence", sql("boxes", """
SELECT video_id, frame_idx, box_ord, arg_min(rule_id, (cls, priority, rule_ord)) rule_id FROM (
  SELECT video_id, frame_idx, box_ord, rule_id, 2 cls, rule_ord,
    CASE rule_id WHEN 'phone_us' THEN 10 WHEN 'email' THEN 10 WHEN 'credit_card' THEN 5 WHEN 'ssn' THEN 5
      WHEN 'url_credentials' THEN 5 ELSE 8 END priority FROM hits
  UNION ALL """ + " UNION ALL ".join(
    f"SELECT video_id, frame_idx, box_ord, 'deny_{w}', 1, {i}, 1 FROM boxes WHERE contains(lower(text), '{w}')"
    for i, w in enumerate(DENIED)) + ") GROUP BY ALL", _HITS))
def rule_precedence(spark: SparkSession, d: str) -> DataFrame:
    priorities = F.create_map(*[F.lit(v) for r in REGEX_RULES for v in (r[0], r[5])])
    regex = document_hits(spark, d).select(
        *oc.FRAME, F.col("first_ord").alias("box_ord"), "rule_id", F.lit("regex").alias("rule_class"),
        priorities[F.col("rule_id")].alias("priority"), "rule_ord",
    )
    deny = oc.deny_list(ad.boxes(spark, d), _deny_rules()).select(
        *BOX, "rule_id", F.lit("denylist").alias("rule_class"), F.lit(1).alias("priority"), "rule_ord"
    )
    return oc.best_rule(regex.unionByName(deny), BOX).select(*BOX, "rule_id")


@query("long_digits", sql("boxes", r"""
SELECT video_id, frame_idx, box_ord, unnest(regexp_extract_all(text, '\d{4,}')) digits FROM boxes"""))
def long_digits(spark: SparkSession, d: str) -> DataFrame:
    return oc.long_digit_runs(ad.boxes(spark, d), 3).select(*BOX, "digits")


@query("similar_text", sql("boxes", r"""
SELECT b.video_id, b.frame_idx, b.box_ord FROM boxes b WHERE (b.video_id, lower(b.text)) IN
  (SELECT video_id, lower(text) FROM boxes WHERE box_ord = 0)"""))
def similar_text(spark: SparkSession, d: str) -> DataFrame:
    b = ad.boxes(spark, d)
    return oc.similar_occurrences(b, b.filter("box_ord = 0")).select(*BOX)


@query("pii_density", sql("boxes", """
SELECT d.video_id, h.pii_type, coalesce(h.n, 0) findings FROM (SELECT DISTINCT video_id FROM boxes) d
LEFT JOIN (SELECT video_id, pii_type, count(*) n FROM hits GROUP BY ALL) h USING (video_id)""", _HITS))
def pii_density(spark: SparkSession, d: str) -> DataFrame:
    videos = ad.table(spark, d, "documents").select(F.col("source").alias("video_id"))
    return oc.pii_density(document_hits(spark, d), videos, ["video_id"])


@query("pii_rollup", sql("boxes", """
SELECT video_id, pii_type, count(*) findings FROM hits GROUP BY ROLLUP (video_id, pii_type)""", _HITS))
def pii_rollup(spark: SparkSession, d: str) -> DataFrame:
    return document_hits(spark, d).rollup("video_id", "pii_type").agg(F.count("*").alias("findings"))
