"""Views of the shared test tables as the engine's input tables.

A document source, a conversation or a user log plays the part of a video; a document, turn or event
is a frame; a line or word is a text box.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.text import strip
from veilmark.plans.session import with_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_boxes(table(spark, sf_dir, "documents"))


def document_boxes(documents: DataFrame) -> DataFrame:
    """One box per line of a document, stacked 20 px apart; documents may be a stream."""
    lines = documents.select(
        "source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).withColumn("clean", strip("line"))
    return lines.selectExpr(
        "source AS video_id",
        "CAST(doc_id AS INT) AS frame_idx",
        "CAST(doc_id * 500 AS INT) AS time_ms",
        "pos AS box_ord",
        "clean AS text",
        "CAST(pmod(doc_id * 31 + pos * 17, 100) AS DOUBLE) / 100 AS confidence",
        "named_struct('x', 10, 'y', 20 * pos, 'w', greatest(1, 8 * length(line)), 'h', 16) AS bbox",
    )


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per line of a page's markup."""
    lines = table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line")
    )
    return lines.selectExpr(
        "'pages' AS video_id",
        "CAST(page_id AS INT) AS frame_idx",
        "CAST(page_id * 500 AS INT) AS time_ms",
        "pos AS box_ord",
        "line AS text",
        "1.0D AS confidence",
        "named_struct('x', 10, 'y', 20 * pos, 'w', greatest(1, 8 * length(line)), 'h', 16) AS bbox",
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per word of a turn, all on one row."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("_veil_conversations")
    return spark.sql("""
        SELECT CAST(conv_id AS STRING) video_id, CAST(turn AS INT) frame_idx, 0 time_ms,
               CAST(pos AS INT) box_ord, word text, 1.0D confidence,
               named_struct(
                 'x', CAST(coalesce(sum(8 * (length(word) + 1)) OVER (
                        PARTITION BY conv_id, turn ORDER BY pos
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT),
                 'y', 0, 'w', CAST(greatest(1, 8 * length(word)) AS INT), 'h', 16) bbox
        FROM _veil_conversations LATERAL VIEW posexplode(split(text, ' ')) t AS pos, word""")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic analyzer spans over the documents; two of the entity types are unmapped."""
    docs = table(spark, sf_dir, "documents").select(
        "source", "doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    )
    return docs.selectExpr(
        "source AS video_id",
        "CAST(doc_id AS INT) AS frame_idx",
        """element_at(array('PHONE_NUMBER','EMAIL_ADDRESS','PERSON','US_SSN','CREDIT_CARD',
           'US_BANK_NUMBER','IP_ADDRESS','DATE_TIME','LOCATION'),
           CAST(pmod(doc_id * 7 + k, 9) AS INT) + 1) AS entity_type""",
        "CAST(pmod(doc_id * 37 + k * 101, n_chars) AS INT) AS start",
        "CAST(pmod(doc_id * 37 + k * 101, n_chars) + 2 + pmod(doc_id + k, 20) AS INT) AS end",
        "CAST(pmod(doc_id * 13 + k * 29, 100) AS DOUBLE) / 100 AS score",
        "k AS span_ord",
    )


def cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cands(table(spark, sf_dir, "events"))


def event_cands(events: DataFrame) -> DataFrame:
    """Candidates from the event log: user = video, event type = kind of data; may be a stream."""
    return events.selectExpr(
        "CAST(user_id AS STRING) AS video_id",
        "event_type AS pii_type",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS time_ms",
        "event_id AS cand_ord",
        "least(1D, value / 500D) AS confidence",
        "CAST(get_json_object(props, '$.k') AS INT) * 10 AS x",
        "CAST(value AS INT) AS y",
        "80 AS w",
        "20 AS h",
        "event_type AS text",
        *(["CAST(ts AS TIMESTAMP) AS at"] if events.isStreaming else []),
    )


def cands_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger candidate set with many equal times, from the line items."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS video_id",
        "l_returnflag AS pii_type",
        "unix_millis(CAST(l_shipdate AS TIMESTAMP)) AS time_ms",
        "l_orderkey * 10 + l_linenumber AS cand_ord",
        "l_discount AS confidence",
        "CAST(l_quantity * 20 AS INT) AS x",
        "CAST(pmod(l_partkey, 500) AS INT) AS y",
        "80 AS w",
        "20 AS h",
        "l_returnflag AS text",
    )


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene cuts of the event log: the error rows of a user."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr(
        "CAST(user_id AS STRING) AS video_id", "unix_millis(CAST(ts AS TIMESTAMP)) AS cut_ms"
    )


def hists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_hists(table(spark, sf_dir, "embeddings"))


def embedding_hists(embeddings: DataFrame) -> DataFrame:
    """One histogram per embedding, from the absolute values of its components; may be a stream."""
    return embeddings.select(
        F.col("label").cast("string").alias("video_id"),
        F.col("vec_id").cast("int").alias("frame_idx"),
        F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("hist"),
    )


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed events from orders: customer = project."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS project_id",
        "o_orderkey AS event_id",
        """CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'rejected' END
           AS status""",
        """element_at(array('phone','email','person','ssn','credit_card'),
           CAST(substring(o_orderpriority, 1, 1) AS INT)) AS pii_type""",
        "CAST(pmod(o_orderkey, 97) AS DOUBLE) / 97 AS confidence",
        """CASE WHEN pmod(o_orderkey, 11) = 0 THEN NULL ELSE concat('T', pmod(o_orderkey, 50)) END
           AS extracted_text""",
        "CAST(pmod(o_orderkey, 600) * 1000 AS INT) AS start_ms",
        "CAST(pmod(o_orderkey, 600) * 1000 + pmod(o_orderkey, 7) * 500 AS INT) AS end_ms",
        """named_struct('type', element_at(array('blur','pixelate','solid_box'),
           CAST(pmod(o_orderkey, 3) AS INT) + 1), 'strength', 15, 'color', '#000000') AS style""",
    )


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch items from orders: customer = batch."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS batch_id",
        "o_orderkey AS item_id",
        """element_at(array('done','error','scanning','exporting','queued'),
           CAST(substring(o_orderpriority, 1, 1) AS INT)) AS status""",
        "CAST(pmod(o_orderkey, 101) AS INT) AS scan_pct",
        "CAST(pmod(o_orderkey * 7, 101) AS INT) AS export_pct",
        "CAST(pmod(o_orderkey, 13) AS INT) AS events_found",
    )


def metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe documents, one per document row."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """concat('{"streams":[{"codec_type":"audio"},{"codec_type":"video","r_frame_rate":"',
           24000 + 1000 * pmod(doc_id, 7), '/1001","width":', 640 + pmod(doc_id * 13, 1281),
           ',"height":', 360 + pmod(doc_id * 7, 721), ',"codec_name":"h264"}],"format":{"duration":"',
           n_chars, '.5","format_name":"mp4"}}') AS probe""",
    )
