"""Event documents that are saved and reopened: JSON lines in buckets of projects.

An event is a line with its fields, followed by lines with its keyframes, a bounded number each. So an event of any length
is written and read by many tasks, and no value grows with an event or a project.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.plans.ordered import chunk_by, ranked
from veilmark.schemas import BBOX, POLYGON, STYLE
from veilmark.sources.buckets import BUCKETS, read_buckets, write_buckets

# Keyframes of a line.
PART_KEYFRAMES = 1000
HEAD = -1

_RANGE = "struct<start_ms:bigint,end_ms:bigint>"
_KEYFRAME = f"struct<time_ms:bigint,bbox:{BBOX.simpleString()},polygon:{POLYGON.simpleString()}>"
_FIELDS = {
    "source": "string", "pii_type": "string", "confidence": "double", "extracted_text": "string",
    "time_ranges": f"array<{_RANGE}>", "tracking_method": "string", "redaction_style": STYLE.simpleString(),
    "status": "string",
}


def _schema(key: str) -> str:
    fields = ", ".join(f"{n} {t}" for n, t in _FIELDS.items())
    return f"`{key}` string, event_id string, part bigint, {fields}, keyframes array<{_KEYFRAME}>"


def event_lines(
    events: DataFrame, keyframes: DataFrame, key: str = "project_id", order: Sequence[str] = ("time_ms",),
    part_keyframes: int = PART_KEYFRAMES, chunk_ms: int = 3_600_000,
) -> DataFrame:
    """Lines (key, event_id, part, fields of the event, keyframes): part -1 holds the fields, others the keyframes from that number on.

    Events have `start_ms` and `end_ms`, or `time_ranges`. Keyframes have `time_ms` and `bbox`, or x, y, w and h, and may
    have a `polygon`; they are numbered along `order`, which begins with the time. Missing fields are null. Repeated
    events and keyframes, keyframes of no event and rows with null ids are all kept.
    """
    if "time_ranges" not in events.columns:
        events = events.withColumn("time_ranges", F.array(F.struct("start_ms", "end_ms")))
    none = F.lit(None)
    head = events.select(
        F.col(key).cast("string").alias(key), F.col("event_id").cast("string").alias("event_id"),
        F.lit(HEAD).cast("bigint").alias("part"),
        *[(F.col(n) if n in events.columns else none).cast(t).alias(n) for n, t in _FIELDS.items()],
        none.cast(f"array<{_KEYFRAME}>").alias("keyframes"),
    )
    bbox = F.col("bbox") if "bbox" in keyframes.columns else F.struct("x", "y", "w", "h")
    polygon = F.col("polygon") if "polygon" in keyframes.columns else none
    numbered = ranked(
        keyframes.withColumn("_k", F.struct(
            F.col("time_ms").cast("bigint").alias("time_ms"), bbox.alias("bbox"), polygon.alias("polygon")
        ).cast(_KEYFRAME)).select(
            F.col(key).cast("string").alias(key), F.col("event_id").cast("string").alias("event_id"), *order, "_k"),
        [key, "event_id"], order, "_n", chunk_by(order[0], chunk_ms),
    )
    parts = numbered.groupBy(key, "event_id", (F.floor((F.col("_n") - 1) / part_keyframes) * part_keyframes).alias("part")).agg(
        # At most `part_keyframes` of them.
        F.sort_array(F.collect_list(F.struct("_n", "_k"))).alias("_ks")
    ).select(
        key, "event_id", "part", *[none.cast(t).alias(n) for n, t in _FIELDS.items()],
        F.col("_ks._k").alias("keyframes"),
    )
    return head.unionByName(parts)


def save_events(
    events: DataFrame, keyframes: DataFrame, path: str, key: str = "project_id", order: Sequence[str] = ("time_ms",),
    part_keyframes: int = PART_KEYFRAMES, buckets: int = BUCKETS, chunk_ms: int = 3_600_000,
) -> None:
    """Save events and their keyframes as JSON lines in buckets of projects."""
    lines = event_lines(events, keyframes, key, order, part_keyframes, chunk_ms)
    write_buckets(lines, path, key, ["event_id", "part"], buckets, "json")


def open_events(
    spark: SparkSession, path: str, key: str = "project_id", ids: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Saved events and keyframes (with `kf_ord` from 0), of all projects or of some."""
    lines = read_buckets(spark, path, _schema(key), key, ids, "json")
    events = lines.filter(F.col("part") == HEAD).select(key, "event_id", *_FIELDS)
    keyframes = lines.filter(F.col("part") > HEAD).select(
        key, "event_id", "part", F.posexplode("keyframes").alias("_i", "k")
    ).select(key, "event_id", (F.col("part") + F.col("_i")).alias("kf_ord"), "k.time_ms", "k.bbox.*", "k.polygon")
    return events, keyframes
