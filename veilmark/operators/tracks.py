"""Post-processing of tracked positions: drift, missing positions, cuts, merging and range growth.

A track has one row per frame in order; `keys` name the track and `order` is its frame column.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.histogram import bhattacharyya
from veilmark.plans.ordered import chunk_by, latest_before, running
from veilmark.plans.session import settle
from veilmark.schemas import BLEND_ALPHA, BLEND_EVERY, DRIFT_FRAMES, DRIFT_THRESHOLD, HOLD_FRAMES

CHUNK_FRAMES = 4096
CHUNK_MARKS = 512


def _streak(
    df: DataFrame, keys: list[str], order: str, hit: Column, reset: Column, chunk_frames: int, **last: Column
) -> DataFrame:
    """Length of the current run of hits; rows that neither hit nor reset leave it as it is.

    Further running values can ride along in the same sweep.
    """
    chunk = chunk_by(order, chunk_frames)
    counted = running(
        df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("long"))
        .withColumn("_reset", F.coalesce(reset, F.lit(False))),
        keys, [order], chunk, total={"_seen": F.col("_hit")},
    )
    based = running(counted, keys, [order], chunk, last={"_base": F.when(F.col("_reset"), F.col("_seen")), **last})
    return based.withColumn("streak", F.col("_seen") - F.coalesce("_base", F.lit(0))).drop(
        "_hit", "_reset", "_seen", "_base"
    )


def _before_stop(df: DataFrame, keys: list[str], order: str, stop: Column) -> DataFrame:
    """Rows ahead of the first stopping row of their track."""
    stops = df.filter(stop).groupBy(*keys).agg(F.min(order).alias("_stop"))
    return df.join(stops, keys, "left").filter(
        F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))
    ).drop("_stop")


def with_reference_drift(tracks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Histogram distance of each row to the first row of its track."""
    first = tracks.groupBy(*keys).agg(F.min_by("hist", order).alias("_ref"))
    return tracks.join(first, keys).withColumn("drift", bhattacharyya(F.col("_ref"), F.col("hist"))).drop("_ref")


def _local_blends(marks: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """What each mark's blends amount to since the start of its chunk: part (a weighted sum) and faded (the weight
    that the reference before the chunk still has). One vector is held at a time."""
    names = [*keys, "_chunk", "_at"]
    schema = T.StructType([*marks.select(*names).schema.fields, T.StructField("part", T.ArrayType(T.DoubleType())), T.StructField("faded", T.DoubleType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, faded = None, None, 1.0
        for batch in batches:
            places = list(zip(*[batch.column(c).to_pylist() for c in names[:-1]]))
            parts, weights = [], []
            for place, hist in zip(places, batch.column("hist")):
                value = np.array(hist.values.to_numpy(zero_copy_only=False), np.float64)
                if place != here:
                    here, held, faded = place, np.zeros(len(value)), 1.0
                held, faded = held * (1 - alpha) + value * alpha, faded * (1 - alpha)
                parts.append(held)
                weights.append(faded)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(parts, pa.list_(pa.float64())), pa.array(weights, pa.float64())], names=schema.names)

    dealt = marks.select(*names, "hist").repartition(*keys, "_chunk").sortWithinPartitions(*names)
    return dealt.mapInArrow(walk, schema)


def _carried_blends(ends: DataFrame, keys: list[str]) -> DataFrame:
    """The reference before each chunk of a track: the pairs (faded, part) of its chunks' ends, chained from the first frame's."""
    names = [*keys, "_chunk"]
    schema = T.StructType([*ends.select(*names).schema.fields, T.StructField("_before", T.ArrayType(T.DoubleType()))])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, reference = None, None
        for batch in batches:
            places = list(zip(*[batch.column(c).to_pylist() for c in keys]))
            out = []
            for place, first, part, faded in zip(places, batch.column("_first"), batch.column("part"), batch.column("faded").to_pylist()):
                if place != here:
                    here, reference = place, np.array(first.values.to_numpy(zero_copy_only=False), np.float64)
                out.append(reference)
                reference = reference * faded + part.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    dealt = ends.select(*names, "_first", "part", "faded").repartition(*keys).sortWithinPartitions(*names)
    return dealt.mapInArrow(chain, schema)


def with_blended_drift(
    tracks: DataFrame, keys: list[str], order: str, every: int = BLEND_EVERY, alpha: float = BLEND_ALPHA,
    chunk_marks: int = CHUNK_MARKS,
) -> DataFrame:
    """Distance to a reference that is blended with the current histogram every few frames.

    A blend replaces the reference by (1 - alpha) of it and alpha of the current histogram. Blends in a row are such a step as well:
    a weight for the reference before them and a weighted sum. So each (track, chunk of `chunk_marks` blends) is walked on its own, the chunks'
    steps are chained along the track, and every blend frame gets its reference from both, for any alpha and any length.

    `order` counts frames; the blend takes effect after its own frame. A frame without a histogram, or with one of another
    size than the track's first, is no blend; the result has the rows and columns of tracks and `drift`.
    """
    first = tracks.groupBy(*keys).agg(
        F.min(order).alias("_start"), F.min_by("hist", order).alias("_first")
    )
    placed = tracks.join(first, keys).withColumn("_since", F.col(order) - F.col("_start")).withColumn(
        "_step", F.floor((F.col("_since") - 1) / every)
    )
    at = F.floor(F.col("_since") / every)
    marks = placed.where((F.col("_since") > 0) & (F.col("_since") % every == 0) & (F.size("hist") == F.size("_first"))).select(
        *keys, at.alias("_at"), F.floor(at / chunk_marks).alias("_chunk"), F.col("hist").cast("array<double>").alias("hist")
    )
    local = settle(_local_blends(marks, keys, alpha))
    ends = local.groupBy(*keys, "_chunk").agg(F.max_by(F.struct("part", "faded"), "_at").alias("end")).select(*keys, "_chunk", "end.*")
    starts = first.select(*keys, F.col("_first").cast("array<double>").alias("_first"))
    carried = _carried_blends(ends.join(starts, keys), keys)
    blends = local.join(carried, [*keys, "_chunk"]).select(
        *keys, F.col("_at").alias("_mark"),
        F.zip_with("_before", "part", lambda r, p: r * F.col("faded") + p).alias("_ref"),
    )
    # Which blend is the latest before each row: the mark itself when no frame is missing.
    stacked = placed.select(*keys, order, "_step", F.lit(1).alias("_k")).unionByName(
        local.select(*keys, F.col("_at").alias("_step"), F.lit(0).alias("_k")), allowMissingColumns=True
    )
    found = running(
        stacked, keys, ["_step", "_k"], chunk_by("_step", CHUNK_FRAMES),
        last={"_mark": F.when(F.col("_k") == 0, F.col("_step"))},
    ).filter("_k = 1").select(*keys, order, "_mark")
    return (
        placed.join(found, [*keys, order]).join(blends, [*keys, "_mark"], "left")
        .withColumn("drift", bhattacharyya(F.coalesce("_ref", "_first"), F.col("hist")))
        .drop("_start", "_first", "_since", "_step", "_mark", "_ref")
    )


def drift_stop(
    tracks: DataFrame, keys: list[str], order: str, threshold: float = DRIFT_THRESHOLD,
    frames: int = DRIFT_FRAMES, chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """End a track at the frame that completes a run of drifted frames; a null drift is passed over."""
    drifted = F.col("drift") > threshold
    counted = _streak(tracks, keys, order, drifted, ~drifted, chunk_frames)
    return _before_stop(counted, keys, order, F.col("streak") >= frames)


def hold_last(
    tracks: DataFrame, keys: list[str], order: str, value: str = "bbox", limit: int = HOLD_FRAMES,
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Carry the last known position over misses; the track ends when too many follow each other."""
    missing = F.col(value).isNull()
    carried = _streak(
        tracks, keys, order, missing, ~missing, chunk_frames, held=F.col(value)
    ).withColumn(value, F.col("held")).drop("held")
    return _before_stop(carried, keys, order, F.col("streak") > limit)


def stop_at_cut(
    tracks: DataFrame, cuts: DataFrame, keys: list[str], order: str, chunk_width: int = CHUNK_FRAMES
) -> DataFrame:
    """Keep the rows of a track before the first scene cut (video_id, cut_at) after its start."""
    starts = tracks.groupBy("video_id", *[k for k in keys if k != "video_id"]).agg(F.min(order).alias("_start"))
    # The first cut after a start is the last one before it on the reversed axis.
    ahead = latest_before(
        starts.withColumn("_back", -F.col("_start")), cuts.withColumn("_mark", -F.col("cut_at")),
        ["video_id"], "_back", "_mark", "_cut", chunk_width,
    ).select("video_id", *[k for k in keys if k != "video_id"], (-F.col("_cut")).alias("_cut"))
    return tracks.join(ahead, list(dict.fromkeys(["video_id", *keys]))).filter(
        F.col("_cut").isNull() | (F.col(order) < F.col("_cut"))
    ).drop("_cut")


def merge_tracks(segments: DataFrame, jobs: DataFrame) -> DataFrame:
    """Join the tracked segments of an event into one keyframe list.

    Segments are (event_id, job_ord, time_ms, x, y, w, h); jobs hold the end keyframe (`end_kf`) of
    each gap. A segment that stopped early gets its end keyframe as an anchor. Of keyframes with equal
    times the one of the earlier job counts.
    """
    reached = segments.groupBy("event_id", "job_ord").agg(F.max("time_ms").alias("_last"))
    anchors = jobs.join(reached, ["event_id", "job_ord"]).filter(F.col("_last") < F.col("end_kf.time_ms")).select(
        "event_id", "job_ord", F.col("end_kf.time_ms").alias("time_ms"),
        *[F.col(f"end_kf.{c}").alias(c) for c in "xywh"], F.lit(1).alias("_pos"),
    )
    both = segments.select("event_id", "job_ord", "time_ms", *"xywh", F.lit(0).alias("_pos")).unionByName(anchors)
    return both.groupBy("event_id", "time_ms").agg(
        F.min_by(F.struct(*"xywh"), F.struct("job_ord", "_pos")).alias("b")
    ).select("event_id", "time_ms", "b.*")


def extend_ranges(events: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Stretch an event's first range to the ends of its forward and backward tracks."""
    ends = forward.groupBy("event_id").agg(F.max("time_ms").alias("_end"))
    starts = backward.groupBy("event_id").agg(F.min("time_ms").alias("_start"))
    return events.join(ends, "event_id", "left").join(starts, "event_id", "left").withColumns({
        "start_ms": F.coalesce("_start", "start_ms"), "end_ms": F.coalesce("_end", "end_ms"),
    }).drop("_end", "_start")
