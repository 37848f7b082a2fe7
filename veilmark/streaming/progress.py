"""Folding progress events of scans and batches into their latest state.

The folds are plain aggregations over (key, seq), so the same code serves a table and, in update
mode, a stream; partial aggregation keeps a busy scan from filling one task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: stages --------------------------------------------------------------------
FINAL_STAGES = ["done", "error", "cancelled"]
PCT_STAGES = ["ocr", "linking", "refining", "track"]
BATCH_STATUS = {
    "video_start": "importing", "video_imported": "scanning", "ocr": "scanning",
    "export_progress": "exporting", "video_done": "done", "video_error": "error",
}


def append_progress(events: DataFrame, path: str, checkpoint: str | None = None):
    """Append progress rows to a table.

    A stream is started and its query returned; a table is written at once.
    """
    if not events.isStreaming:
        events.write.mode("append").parquet(path)
        return None
    writer = events.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint or f"{path}_state").trigger(availableNow=True).start()


def _newest(value: Column, when: Column) -> Column:
    return F.max_by(value, F.when(when & value.isNotNull(), F.col("seq")))


def progress_state(events: DataFrame) -> DataFrame:
    """Latest state per scan: stage, percent, findings, running flag and warning.

    `starting` resets, `done` sets the percent to 100, final stages stop the scan, a warning's
    message stays until the next start.
    """
    stage = F.col("stage")
    pct = (
        F.when(stage == "starting", F.lit(0)).when(stage == "done", F.lit(100))
        .when(stage.isin(PCT_STAGES), F.col("progress_pct"))
    )
    found = (
        F.when(stage == "starting", F.lit(0)).when(stage == "ocr", F.col("findings"))
        .when(stage == "done", F.coalesce("findings", F.lit(0)))
    )
    live = F.when(stage == "starting", F.lit(True)).when(stage.isin(FINAL_STAGES), F.lit(False))
    note = F.when(stage == "starting", F.lit("")).when(stage == "warning", F.col("message"))
    everything = F.lit(True)
    return events.groupBy("scan_id").agg(
        F.max_by("stage", "seq").alias("stage"),
        F.coalesce(_newest(pct, everything), F.lit(0)).alias("progress_pct"),
        F.coalesce(_newest(found, everything), F.lit(0)).alias("findings"),
        F.coalesce(_newest(live, everything), F.lit(False)).alias("is_running"),
        F.nullif(_newest(note, everything), F.lit("")).alias("warning"),
    )


def batch_item_state(events: DataFrame) -> DataFrame:
    """Latest state per batch item: status, scan and export percent, findings and error."""
    stage = F.col("stage")
    status_of = F.create_map(*[F.lit(v) for pair in BATCH_STATUS.items() for v in pair])
    status = F.try_element_at(status_of, stage)
    scan = F.when(stage == "ocr", F.col("pct")).when(stage == "scan_done", F.lit(100))
    export = F.when(stage == "export_progress", F.col("pct")).when(stage == "video_done", F.lit(100))
    found = F.when(stage == "scan_done", F.coalesce("events_found", F.lit(0)))
    error = F.when(stage == "video_error", F.col("error"))
    everything = F.lit(True)
    return events.groupBy("batch_id", "item_idx").agg(
        F.coalesce(_newest(status, everything), F.lit("queued")).alias("status"),
        F.coalesce(_newest(scan, everything), F.lit(0)).alias("scan_pct"),
        F.coalesce(_newest(export, everything), F.lit(0)).alias("export_pct"),
        F.coalesce(_newest(found, everything), F.lit(0)).alias("events_found"),
        _newest(error, everything).alias("error"),
    )
