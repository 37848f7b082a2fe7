"""Normalising text boxes and detections before classification."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import geometry as geo
from veilmark.functions.numeric import frame_to_ms, usable_fps, whole
from veilmark.functions.text import strip
from veilmark.schemas import (
    DEFAULT_THRESHOLD, MIN_BOX_CONFIDENCE, MIN_SIDE_PX, SPARSE_FRAME_BOXES,
)

FRAME = ["video_id", "frame_idx"]


def filter_boxes(boxes: DataFrame, minimum: float = MIN_BOX_CONFIDENCE) -> DataFrame:
    """Drop blank and uncertain boxes; trim the rest."""
    return (
        boxes.filter(F.col("confidence") >= minimum)
        .withColumn("text", strip(F.col("text"))).filter(F.length("text") > 0)
    )


def polygons_to_boxes(df: DataFrame, polygon: str = "polygon", inclusive: bool = True) -> DataFrame:
    return df.withColumn("bbox", geo.polygon_box(F.col(polygon), inclusive))


def rescale_boxes(boxes: DataFrame, scale: float) -> DataFrame:
    """Back from a scaled frame to source pixels."""
    return boxes.withColumn("bbox", geo.shrink_box(F.col("bbox"), F.lit(float(scale))))


def scale_to_output(df: DataFrame, fx: Column, fy: Column) -> DataFrame:
    """From source pixels to output pixels; polygons too where present."""
    out = df.withColumn("bbox", geo.scale_box(F.col("bbox"), fx, fy))
    if "polygon" in df.columns:
        out = out.withColumn("polygon", geo.scale_polygon(F.col("polygon"), fx, fy))
    return out


def sparse_retry_union(base: DataFrame, retry: DataFrame, fewer_than: int = SPARSE_FRAME_BOXES) -> DataFrame:
    """Complete frames with few boxes by a second pass; texts already read there are not added again.

    A frame without any base box is sparse too. Both tests are anti-joins keyed by frame, and the
    retry rows are not deduplicated among themselves.
    """
    full = base.groupBy(*FRAME).agg(F.count("*").alias("n")).filter(F.col("n") >= fewer_than)
    known = base.select(*FRAME, F.lower("text").alias("_t")).distinct()
    added = (
        retry.join(full, FRAME, "left_anti").withColumn("_t", F.lower("text"))
        .join(known, [*FRAME, "_t"], "left_anti").drop("_t")
    )
    return base.unionByName(added)


def detections_to_pixels(
    detections: DataFrame, width: Column, height: Column, minimum: Column, min_side: int = MIN_SIDE_PX
) -> DataFrame:
    """Corner shares x1, y1, x2, y2 to clamped pixel boxes; small and uncertain ones are dropped."""
    left = F.greatest(F.lit(0), whole(F.col("x1") * width))
    top = F.greatest(F.lit(0), whole(F.col("y1") * height))
    right = F.least(width.cast("int"), whole(F.col("x2") * width))
    bottom = F.least(height.cast("int"), whole(F.col("y2") * height))
    return (
        detections.filter(F.col("confidence") >= minimum)
        .withColumn("bbox", geo.make_box(left, top, right - left, bottom - top))
        .filter((F.col("bbox.w") >= min_side) & (F.col("bbox.h") >= min_side))
        .drop("x1", "y1", "x2", "y2")
    )


def face_threshold(overrides: Mapping[str, float] | None, threshold: float = DEFAULT_THRESHOLD) -> float:
    return float((overrides or {}).get("face", threshold))


def face_candidates(faces: DataFrame) -> DataFrame:
    """Face boxes as candidates; `face_ord` is the detector's order."""
    return faces.select(
        *FRAME, "time_ms", F.lit("face").alias("pii_type"), "confidence", F.lit("[face]").alias("text"),
        "bbox", F.lit("face").alias("source"), F.lit(0).alias("rule_ord"),
        F.col("face_ord").alias("first_ord"), F.lit(0).alias("second_ord"),
    )


def with_frame_time(frames: DataFrame, fps: Column, frame: str = "frame_idx") -> DataFrame:
    return frames.withColumn("time_ms", frame_to_ms(F.col(frame), usable_fps(fps)))
