"""Text box tables: reading and a layout that prunes well."""

from pyspark.sql import DataFrame, SparkSession

from veilmark.schemas import BOX


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """A long table of boxes of many videos."""
    return spark.read.schema(BOX).parquet(path)


def write_boxes(boxes: DataFrame, path: str, files: int | None = None) -> None:
    """Lay boxes out by video and frame, so range scans skip row groups.

    Range partitioning splits a hot video over several files.
    """
    place = ["video_id", "frame_idx", "box_ord"]
    laid = boxes.repartitionByRange(files, *place) if files else boxes.repartitionByRange(*place)
    laid.sortWithinPartitions(*place).write.mode("overwrite").parquet(path)
