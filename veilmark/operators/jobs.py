"""Batches, audit summaries and detection quality."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.geometry import iou


def batch_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each batch; it runs while an item is neither done nor failed."""
    done = F.count_if(F.col("status") == "done")
    failed = F.count_if(F.col("status") == "error")
    return items.groupBy(*keys).agg(
        F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"),
        F.sum("events_found").alias("events_found"),
    ).withColumn(
        "batch_status",
        F.when(F.col("completed") + F.col("failed") == F.col("total"), F.lit("done")).otherwise(F.lit("running")),
    )


def item_pct() -> Column:
    """Overall progress of a batch item."""
    status = F.col("status")
    return (
        F.when(status == "importing", F.lit(5.0))
        .when(status == "scanning", 10 + F.col("scan_pct") * 0.5)
        .when(status == "exporting", 60 + F.col("export_pct") * 0.4)
        .when(status == "done", F.lit(100.0)).otherwise(F.lit(0.0))
    )


def isolate_failures(videos: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Videos to scan, and failed batch items with their error; a failure does not stop the rest."""
    judged = videos.withColumn("error", problem)
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL").select(
        "video_id", F.lit("error").alias("status"), "error"
    )


def batch_scan(
    videos: DataFrame, boxes: DataFrame, problem: Column, scan, auto_accept: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Scan all sound videos of a batch in one plan; returns the events and one item row per video."""
    sound, failed = isolate_failures(videos, problem)
    events = scan(boxes.join(sound.select("video_id"), "video_id", "left_semi"))
    if auto_accept:
        events = events.withColumn("status", F.lit("accepted"))
    found = events.groupBy("video_id").agg(F.count("*").alias("events_found"))
    items = sound.select("video_id").join(found, "video_id", "left").select(
        "video_id", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"),
        F.coalesce("events_found", F.lit(0)).alias("events_found"),
    ).unionByName(failed.withColumn("events_found", F.lit(0)))
    return events, items


def audit_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    accepted = F.count_if(F.col("status") == "accepted")
    rejected = F.count_if(F.col("status") == "rejected")
    return events.groupBy(*keys).agg(
        F.count("*").alias("total_events"), accepted.alias("accepted"), rejected.alias("rejected"),
        (F.count("*") - accepted - rejected).alias("pending"),
    )


def audit_events(events: DataFrame, secure: Column | None = None) -> DataFrame:
    """Accepted events as reported; texts are withheld in secure mode."""
    hidden = F.lit(False) if secure is None else secure
    return events.filter("status = 'accepted'").select(
        "project_id", "event_id", "pii_type", "confidence",
        F.when(~hidden, F.col("extracted_text")).alias("extracted_text"), "start_ms", "end_ms",
        "tracking_method", F.col("style.type").alias("redaction_style"),
    )


def detection_metrics(found: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Precision and recall by matching keys; both sides hold distinct keys."""
    f = found.select(*keys, *by).distinct().withColumn("_f", F.lit(1))
    t = truth.select(*keys, *by).distinct().withColumn("_t", F.lit(1))
    hit = F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull())
    return f.join(t, [*keys, *by], "full_outer").groupBy(*by).agg(
        hit.alias("true_positives"), F.count_if(F.col("_t").isNull()).alias("false_positives"),
        F.count_if(F.col("_f").isNull()).alias("false_negatives"),
    ).withColumns({
        "precision": F.try_divide(F.col("true_positives"), F.col("true_positives") + F.col("false_positives")),
        "recall": F.try_divide(F.col("true_positives"), F.col("true_positives") + F.col("false_negatives")),
    })


def match_boxes(found: DataFrame, truth: DataFrame, minimum: float = 0.5, cell: int = 256) -> DataFrame:
    """Best found box per true box of the same frame and type by overlap, over grid cells.

    Both tables: video_id, frame_idx, pii_type, id, bbox.
    """
    def laid(df: DataFrame, name: str) -> DataFrame:
        b = F.col("bbox")
        span = lambda low, size: F.sequence(F.floor(low / cell), F.floor((low + size) / cell))
        return df.select(
            "video_id", "frame_idx", "pii_type", F.col("id").alias(f"{name}_id"), b.alias(f"{name}_box"),
            F.explode(span(b["x"], b["w"])).alias("gx"),
        ).withColumn("gy", F.explode(span(F.col(f"{name}_box.y"), F.col(f"{name}_box.h"))))

    a, b = F.col("found_box"), F.col("true_box")
    met = laid(found, "found").join(laid(truth, "true"), ["video_id", "frame_idx", "pii_type", "gx", "gy"]).filter(
        (F.col("gx") == F.floor(F.greatest(a["x"], b["x"]) / cell))
        & (F.col("gy") == F.floor(F.greatest(a["y"], b["y"]) / cell))
    ).withColumn("iou", iou(a, b)).filter(F.col("iou") >= minimum)
    return met.groupBy("video_id", "frame_idx", "pii_type", "true_id").agg(
        F.max(F.struct("iou", "found_id")).alias("m")
    ).select("video_id", "frame_idx", "pii_type", "true_id", "m.found_id", "m.iou")


def corrections_per_minute(log: DataFrame, videos: DataFrame) -> DataFrame:
    """Manual keyframe edits per minute of video."""
    edits = log.filter("kind = 'keyframes'").groupBy("project_id").agg(F.count("*").alias("edits"))
    return videos.join(edits, "project_id", "left").select(
        "project_id", F.coalesce("edits", F.lit(0)).alias("edits"),
        F.try_divide(F.coalesce("edits", F.lit(0)) * 60000.0, F.col("duration_ms")).alias("per_minute"),
    )


def latest_per(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The newest row per key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter(
        "_rn = 1"
    ).drop("_rn")
