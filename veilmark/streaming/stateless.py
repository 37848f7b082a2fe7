"""Streams without custom state: classification, windows, sessions and deduplication.

The batch operators are used as they are: they take a DataFrame and run no action.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.operators.boxes import filter_boxes
from veilmark.operators.classify import regex_candidates
from veilmark.plans.session import shared_folder
from veilmark.schemas import LINK_GAP_MS


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one test table; the schema comes from the table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parque[t]")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into the shared folder and read the result back."""
    spark = stream.sparkSession
    root = shared_folder(spark)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{root}/state").option("path", f"{root}/rows").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drain an update-mode stream; the newest batch of each key counts.

    Each batch replaces its own folder, so a repeated batch does no harm.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)

    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{root}/state").foreachBatch(save).start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{root}/rows")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def stream_classify(
    boxes: DataFrame, rules: Iterable[dict], threshold: float, overrides: dict | None = None
) -> DataFrame:
    """Regex candidates of arriving boxes."""
    return regex_candidates(filter_boxes(boxes), rules, threshold, overrides)


def stream_sessions(
    findings: DataFrame, at: str, gap_ms: int = LINK_GAP_MS, lateness: str = "10 minutes"
) -> DataFrame:
    """Runs of findings of one video and kind without a silence longer than the gap."""
    return (
        findings.withWatermark(at, lateness)
        .groupBy("video_id", "pii_type", F.session_window(at, f"{gap_ms} milliseconds").alias("s"))
        .agg(F.count("*").alias("findings"), F.max("confidence").alias("confidence"))
        .select("video_id", "pii_type", F.col("s.start").alias("start"), F.col("s.end").alias("end"),
                "findings", "confidence")
    )


def stream_window_counts(
    findings: DataFrame, at: str, size: str, slide: str | None = None, lateness: str = "10 minutes"
) -> DataFrame:
    """Findings per kind and time window, tumbling or sliding."""
    span = F.window(at, size, slide) if slide else F.window(at, size)
    return (
        findings.withWatermark(at, lateness).groupBy(span.alias("w"), "pii_type")
        .agg(F.count("*").alias("findings"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pii_type", "findings")
    )


def dedupe_stream(candidates: DataFrame, at: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """One candidate per key within the watermark."""
    return candidates.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
