"""Queries that run as streams over the test tables and return the drained result."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.catalog.base import GAP_MS, TOLERANCE_PX, query, sql
from veilmark.catalog.detection import _DIST, _HITS, _PAIRS
from veilmark.catalog.reviewing import redact_oracle
from veilmark.catalog.detection import REGEX_RULES, oracle_spans
from veilmark.operators.redact import redact_text
from veilmark.plans.session import shared_folder, with_utc
from veilmark.schemas import DEFAULT_THRESHOLD
from veilmark.sources import adapters as ad
from veilmark.sources.rules import builtin_rules
from veilmark.streaming import progress as pg
from veilmark.streaming import stateful as sf
from veilmark.streaming import stateless as sl


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return sl.table_stream(with_utc(spark), d, name)


@query("stream_classify", sql("boxes", """
SELECT video_id, frame_idx, time_ms, rule_id, pii_type, text, x, y, w, h FROM hits h
WHERE (SELECT b.confidence FROM boxes b WHERE b.video_id = h.video_id AND b.frame_idx = h.frame_idx
       AND b.box_ord = h.box_ord) >= 0.25""", _HITS))
def stream_classify(spark: SparkSession, d: str) -> DataFrame:
    arriving = ad.document_boxes(_stream(spark, d, "documents"))
    found = sl.stream_classify(arriving, builtin_rules(), DEFAULT_THRESHOLD)
    return sl.run_to_table(found).select("video_id", "frame_idx", "time_ms", "rule_id", "pii_type", "text", "bbox.*")


@query("stream_redact", redact_oracle(
    "documents", "doc_id", "text", oracle_spans("documents", "doc_id", "text", REGEX_RULES), "repeat('█', length(p))"))
def stream_redact(spark: SparkSession, d: str) -> DataFrame:
    done = redact_text(_stream(spark, d, "documents").select("doc_id", "text"), "text", builtin_rules())
    return sl.run_to_table(done).select("doc_id", "n_spans", F.sha2("redacted", 256).alias("redacted_hash"))


# In append mode a window shows once the watermark (newest time less ten minutes) has passed its end.
_CLOSED = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)"


@query("stream_sessions", f"""
SELECT video_id, pii_type, min(us) // 1000 start_ms, (max(us) + 21600000000) // 1000 end_ms, count(*) findings,
  max(confidence) confidence
FROM (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= 21600000000 THEN 1 ELSE 0 END) OVER w s FROM (
  SELECT user_id::VARCHAR video_id, event_type pii_type, epoch_us(ts) us, event_id, least(1::DOUBLE, value / 500::DOUBLE) confidence,
    lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) p FROM events)
  WINDOW w AS (PARTITION BY video_id, pii_type ORDER BY us, event_id))
GROUP BY video_id, pii_type, s HAVING max(us) + 21600000000 <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    done = sl.run_to_table(sl.stream_sessions(ad.event_cands(_stream(spark, d, "events")), "at", 21_600_000))
    return done.select(
        "video_id", "pii_type", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"),
        "findings", "confidence",
    )


@query("stream_windows", f"""
SELECT * FROM (SELECT epoch_us(date_trunc('day', ts)) // 1000 start_ms, event_type pii_type, count(*) findings
  FROM events GROUP BY 1, 2) WHERE start_ms * 1000 + 86400000000 <= {_CLOSED}""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    done = sl.run_to_table(sl.stream_window_counts(ad.event_cands(_stream(spark, d, "events")), "at", "1 day"))
    return done.select(F.unix_millis("start").alias("start_ms"), "pii_type", "findings")


@query("stream_sliding", f"""
SELECT * FROM (SELECT (epoch_us(ts) // 21600000000 - k) * 21600000 start_ms, event_type pii_type, count(*) findings
  FROM events, range(0, 4) r(k) GROUP BY 1, 2) WHERE start_ms * 1000 + 86400000000 <= {_CLOSED}""")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    counted = sl.stream_window_counts(ad.event_cands(_stream(spark, d, "events")), "at", "1 day", "6 hours")
    return sl.run_to_table(counted).select(F.unix_millis("start").alias("start_ms"), "pii_type", "findings")


@query("stream_dedupe", sql("cands", "SELECT DISTINCT video_id, pii_type, y FROM cands"))
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    arriving = ad.event_cands(_stream(spark, d, "events"))
    once = sl.dedupe_stream(arriving, "at", ["video_id", "pii_type", "y"], "60 days")
    return sl.run_to_table(once).select("video_id", "pii_type", "y")


_STAGE = """CASE event_type WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'linking' WHEN 'purchase' THEN 'warning'
  WHEN 'error' THEN 'done' ELSE 'starting' END"""


@query("stream_progress", f"""
WITH p AS (SELECT user_id::VARCHAR scan_id, event_id seq, {_STAGE} stage, trunc(value)::INT % 100 progress_pct,
  (event_id % 50)::INT findings, concat('m', event_id) message FROM events)
SELECT scan_id, arg_max(stage, seq) stage,
  coalesce(arg_max(CASE stage WHEN 'starting' THEN 0 WHEN 'done' THEN 100 ELSE progress_pct END, seq)
    FILTER (stage <> 'warning'), 0)::INT progress_pct,
  coalesce(arg_max(CASE stage WHEN 'starting' THEN 0 ELSE findings END, seq) FILTER (stage IN ('starting', 'ocr', 'done')), 0)::INT findings,
  coalesce(arg_max(stage = 'starting', seq) FILTER (stage IN ('starting', 'done')), false) is_running,
  nullif(arg_max(CASE stage WHEN 'starting' THEN '' ELSE message END, seq) FILTER (stage IN ('starting', 'warning')), '') warning
FROM p GROUP BY ALL""")
def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d, "events").selectExpr(
        "CAST(user_id AS STRING) scan_id", "event_id seq", f"{_STAGE} stage", "CAST(value AS INT) % 100 progress_pct",
        "CAST(event_id % 50 AS INT) findings", "concat('m', event_id) message",
    )
    return sl.run_updates(pg.progress_state(events), ["scan_id"])


@query("progress_log", f"""
SELECT user_id::VARCHAR scan_id, event_id seq, {_STAGE} stage FROM events""")
def progress_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d, "events").selectExpr("CAST(user_id AS STRING) scan_id", "event_id seq", f"{_STAGE} stage")
    path = shared_folder(spark)
    pg.append_progress(rows, path).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


_BATCH_STAGE = """CASE event_type WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'export_progress' WHEN 'purchase' THEN 'scan_done'
  WHEN 'error' THEN 'video_error' ELSE 'video_start' END"""


@query("batch_item_state", f"""
WITH p AS (SELECT user_id::VARCHAR batch_id, event_id seq, json_extract_string(props, '$.k')::INT % 5 item_idx, {_BATCH_STAGE} stage,
  trunc(value)::INT % 100 pct, (event_id % 50)::INT events_found, concat('e', event_id) error FROM events)
SELECT batch_id, item_idx,
  coalesce(arg_max(CASE stage WHEN 'ocr' THEN 'scanning' WHEN 'export_progress' THEN 'exporting' WHEN 'video_error' THEN 'error'
    ELSE 'importing' END, seq) FILTER (stage <> 'scan_done'), 'queued') status,
  coalesce(arg_max(CASE stage WHEN 'ocr' THEN pct ELSE 100 END, seq) FILTER (stage IN ('ocr', 'scan_done')), 0)::INT scan_pct,
  coalesce(arg_max(pct, seq) FILTER (stage = 'export_progress'), 0)::INT export_pct,
  coalesce(arg_max(events_found, seq) FILTER (stage = 'scan_done'), 0)::INT events_found,
  arg_max(error, seq) FILTER (stage = 'video_error') error FROM p GROUP BY ALL""")
def batch_item_state(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d, "events").selectExpr(
        "CAST(user_id AS STRING) batch_id", "event_id seq", "CAST(get_json_object(props, '$.k') AS INT) % 5 item_idx",
        f"{_BATCH_STAGE} stage", "CAST(value AS INT) % 100 pct", "CAST(event_id % 50 AS INT) events_found",
        "concat('e', event_id) error",
    )
    return sl.run_updates(pg.batch_item_state(events), ["batch_id", "item_idx"])


@query("stream_scene_change", sql("hists", f"""
SELECT video_id, prev_frame, frame_idx, round(dist, 9) distance FROM (
  SELECT *, {_DIST.format(a='prev', b='hist')} dist FROM ({_PAIRS}) WHERE prev IS NOT NULL) WHERE dist > 0.4"""))
def stream_scene_change(spark: SparkSession, d: str) -> DataFrame:
    arriving = ad.embedding_hists(_stream(spark, d, "embeddings"))
    return sl.run_to_table(sf.stream_scene_changes(arriving, 0.40)).withColumn("distance", F.round("distance", 9))


@query("stream_timed_scenes", sql("hists", f"""
SELECT video_id, prev_frame, frame_idx, round(dist, 9) distance FROM (
  SELECT *, {_DIST.format(a='prev', b='hist')} dist FROM ({_PAIRS}) WHERE prev IS NOT NULL)
WHERE dist > 0.4 AND frame_idx * 1000 <= (SELECT max(frame_idx) * 1000 - 20000 FROM hists)"""))
def stream_timed_scenes(spark: SparkSession, d: str) -> DataFrame:
    """By event time: a frame is judged once the watermark has passed it, 20 seconds behind the newest frame."""
    arriving = ad.embedding_hists(_stream(spark, d, "embeddings")).withColumn("at", F.timestamp_millis(F.col("frame_idx").cast("long") * 1000))
    found = sl.run_to_table(sf.stream_timed_scene_changes(arriving, "at", 0.40, "20 seconds", 1 << 40))
    return found.withColumn("distance", F.round("distance", 9))


# An event is out once the watermark has passed its end by the gap: until then a late row could still belong to it.
_CLOSED = f"end_ms + {GAP_MS} < (SELECT max(time_ms) - 600000 FROM cands)"


@query("stream_link", sql("summary", f"""
SELECT video_id, pii_type, seed_ms, seed_ord, start_ms, end_ms, n_keyframes, confidence FROM summary WHERE {_CLOSED}"""))
def stream_link(spark: SparkSession, d: str) -> DataFrame:
    arriving = ad.event_cands(_stream(spark, d, "events"))
    return sl.run_to_table(sf.stream_link(arriving, "at", GAP_MS, TOLERANCE_PX))
