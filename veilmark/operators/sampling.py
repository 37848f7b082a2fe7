"""Which frames to look at: fixed steps, ranges, changes, bursts and boundaries."""

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.histogram import bhattacharyya, mean_abs_diff
from veilmark.functions.numeric import frame_to_ms, ms_to_frame
from veilmark.plans.ordered import chunk_by, ranked, running
from veilmark.plans.session import settle
from veilmark.schemas import (
    BOUNDARY_FRAMES, BURST_SAMPLES, MOTION_THRESHOLD, REFINE_BUDGET, REFINE_MINIMUM, SCENE_THRESHOLD,
)

CHUNK_FRAMES = 4096


def sample_fixed(frames: DataFrame, step: int) -> DataFrame:
    return frames.filter(F.col("frame_idx") % step == 0)


def sample_range(frames: DataFrame, start_ms: int, end_ms: int, fps: float) -> DataFrame:
    """Frames of an inclusive time range; plain bounds on the frame column reach the scan."""
    first, last = int(start_ms / 1000 * fps), int(end_ms / 1000 * fps)
    return frames.filter(F.col("frame_idx").between(first, last))


def intensity_histogram(
    values: DataFrame, keys: list[str], value: str, bins: int = 256, low: float = 0.0, high: float = 256.0
) -> DataFrame:
    """Histogram of unit length (Euclidean norm) per key; all zero where no value falls in range.

    Bins are counted before the key is gathered, so a key brings at most `bins` rows to its task.
    """
    slot = F.floor((F.col(value) - low) * (bins / (high - low))).cast("int")
    counted = values.select(*keys, slot.alias("slot")).groupBy(*keys, "slot").agg(F.count("*").alias("n"))
    inside = F.col("slot").between(0, bins - 1)
    by_slot = F.map_from_entries(F.collect_list(F.when(inside, F.struct("slot", F.col("n").cast("double")))))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0)),
    )
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, v: a + v * v))
    return (
        counted.groupBy(*keys).agg(by_slot.alias("m")).withColumn("raw", raw).withColumn("norm", norm)
        .select(*keys, F.transform(
            "raw", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(F.lit(0.0))
        ).alias("hist"))
    )


def consecutive(samples: DataFrame, value: str, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Each sample with the one before it in its video."""
    return running(
        samples, ["video_id"], ["frame_idx"], chunk_by("frame_idx", chunk_frames),
        prior={"before": F.struct("frame_idx", value)},
    )


def scene_changes(
    hists: DataFrame, threshold: float = SCENE_THRESHOLD, chunk_frames: int = CHUNK_FRAMES
) -> DataFrame:
    """Consecutive samples whose histograms are far apart."""
    pairs = consecutive(hists, "hist", chunk_frames).filter("before IS NOT NULL")
    return pairs.select(
        "video_id", F.col("before.frame_idx").alias("prev_frame"), "frame_idx",
        bhattacharyya(F.col("before.hist"), F.col("hist")).alias("distance"),
    ).filter(F.col("distance") > threshold)


def motion(
    values: DataFrame, threshold: float = MOTION_THRESHOLD, value: str = "hist",
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Consecutive samples whose values differ much on average."""
    pairs = consecutive(values, value, chunk_frames).filter("before IS NOT NULL")
    return pairs.select(
        "video_id", F.col("before.frame_idx").alias("prev_frame"), "frame_idx",
        mean_abs_diff(F.col(f"before.{value}"), F.col(value)).alias("mad"),
    ).filter(F.col("mad") >= threshold)


def scene_cut_times(changes: DataFrame, fps: Column, strict: bool = False) -> DataFrame:
    """Cut times of changes. A cut must lie strictly between the two samples to split a link, so it is
    put midway; `strict` keeps the earlier sample's time instead."""
    earlier = frame_to_ms(F.col("prev_frame"), fps, "long")
    later = frame_to_ms(F.col("frame_idx"), fps, "long")
    at = earlier if strict else F.floor((earlier + later) / 2)
    return changes.select("video_id", at.alias("cut_ms"))


def estimated_samples(videos: DataFrame, interval: int) -> DataFrame:
    return videos.withColumn(
        "estimated_samples", F.greatest(F.lit(1), F.floor(F.col("total_frames") / interval)).cast("int")
    )


# ---- adaptive sampling -----------------------------------------------------------------------
#
# The sampler steps through a video by `interval`, or by half of it while a burst lasts, and each
# decision compares a sample with the one before. So the state between two frames is only: where
# the next sample falls, which of the two steps led there, and how much of the burst is left. For a
# chunk of frames the exit state can be tabulated for every possible entry state without knowing what
# came before; chaining these small tables gives every chunk its true entry state, and all chunks are
# then walked at once. No video has to pass through a single task.

_FLAG = ["scene_full", "scene_half", "motion_full", "motion_half"]


def _burst_after(burst, scene, moved):
    """Burst left when a sample is taken, before it is used up."""
    if scene:
        return BURST_SAMPLES
    return BURST_SAMPLES if burst == 0 and moved else burst


def _exits(interval: int, half: int, width: int):
    """Exit state of one chunk for every entry state, by working back from the chunk's end."""
    depth = BURST_SAMPLES + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        start, stop = chunk * width, (chunk + 1) * width
        flags = np.zeros((width, 4), dtype=bool)
        flags[pdf["frame_idx"].to_numpy() - start] = pdf[_FLAG].to_numpy(dtype=bool)
        # exits[offset, step kind, burst] names the state on leaving the chunk by its place among
        # the states (frames past the end, step kind, burst); the states past the end are their own.
        exits = np.empty((width + interval, 2, depth), dtype=np.int64)
        exits[width:] = np.arange(interval * 2 * depth).reshape(interval, 2, depth)
        bursts_left = [
            np.array([_burst_after(b, scene, moved) for b in range(depth)])
            for scene in (False, True) for moved in (False, True)
        ]
        for at in range(width - 1, -1, -1):
            for kind in (0, 1):
                left = bursts_left[2 * int(flags[at, kind]) + int(flags[at, 2 + kind])]
                exits[at, kind] = np.where(
                    left > 0, exits[at + half, 1, np.maximum(left - 1, 0)], exits[at + interval, 0, 0]
                )
        offsets, kinds, bursts = np.meshgrid(
            np.arange(interval), np.arange(2), np.arange(depth), indexing="ij"
        )
        over, kind_out, burst_out = np.unravel_index(
            exits[offsets.ravel(), kinds.ravel(), bursts.ravel()], (interval, 2, depth)
        )
        return pd.DataFrame({
            "video_id": pdf["video_id"].iloc[0], "chunk": chunk,
            "enter_frame": start + offsets.ravel(), "enter_kind": kinds.ravel(),
            "enter_burst": bursts.ravel(), "exit_frame": stop + over, "exit_kind": kind_out,
            "exit_burst": burst_out,
        })

    return solve


def _chain(first_frame: int):
    """Follow the true state through a video's chunk tables, which arrive in chunk order."""

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, state, chunk = None, None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row.video_id != video:
                    video, chunk = row.video_id, None
                    # The very first sample has nothing to compare with; kind -1 says so.
                    state = (first_frame, 0, 0)
                if row.chunk != chunk:
                    chunk, entered = row.chunk, state
                    out.append((video, chunk, *entered))
                if (row.enter_frame, row.enter_kind, row.enter_burst) == entered:
                    state = (row.exit_frame, row.exit_kind, row.exit_burst)
            yield pd.DataFrame(
                out, columns=["video_id", "chunk", "enter_frame", "enter_kind", "enter_burst"]
            )

    return follow


def _emit(interval: int, half: int, width: int):
    """Samples of one chunk from its true entry state; a missing frame is passed over as one without a change."""
    missing = SimpleNamespace(scene_full=False, scene_half=False, motion_full=False, motion_half=False)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = pdf.sort_values("frame_idx")
        rows = {r.frame_idx: r for r in frames.itertuples(index=False)}
        at = int(frames["enter_frame"].iloc[0])
        kind, burst = int(frames["enter_kind"].iloc[0]), int(frames["enter_burst"].iloc[0])
        out = []
        video, stop = frames["video_id"].iloc[0], (int(frames["chunk"].iloc[0]) + 1) * width
        while at < stop:
            row = rows.get(at, missing)
            scene, moved = (row.scene_half, row.motion_half) if kind else (row.scene_full, row.motion_full)
            step = half if kind else interval
            burst = _burst_after(burst, scene, moved)
            if row is not missing:
                out.append((video, at, at - step if at - step >= 0 else None, bool(scene), burst))
            if burst > 0:
                at, kind, burst = at + half, 1, burst - 1
            else:
                at, kind = at + interval, 0
        return pd.DataFrame(out, columns=["video_id", "frame_idx", "prev_frame", "scene", "burst"])

    return walk


def adaptive_sample(
    frames: DataFrame, interval: int, scene_threshold: float = SCENE_THRESHOLD,
    motion_threshold: float = MOTION_THRESHOLD, hist: str = "hist", pixels: str = "hist",
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """Sampled frames with the sample before, whether the scene changed, and the burst left.

    `frames` holds the frames of a video, numbered from 0. A missing frame is not sampled and counts as one
    without a change, also for the frame that would be compared with it; the steps go on behind it. The last
    frame of a video is always sampled.
    """
    half = max(1, interval // 2)
    width = max(chunk_frames, interval)
    at = F.floor(F.col("frame_idx") / width)
    # The last frames of a chunk are repeated in the next one, so that looking back stays inside.
    spread = frames.select(
        "video_id", "frame_idx", F.col(hist).alias("_h"), F.col(pixels).alias("_p"), at.alias("_home"),
        F.explode(F.when(
            F.col("frame_idx") >= (at + 1) * width - interval, F.array(at, at + 1)
        ).otherwise(F.array(at))).alias("chunk"),
    )
    back = Window.partitionBy("video_id", "chunk").orderBy("frame_idx")

    def compared(offset: int, name: str) -> list[Column]:
        known = F.col("frame_idx") - F.lag("frame_idx", offset).over(back) == offset
        scene = known & (bhattacharyya(F.lag("_h", offset).over(back), F.col("_h")) > scene_threshold)
        moved = known & (mean_abs_diff(F.lag("_p", offset).over(back), F.col("_p")) >= motion_threshold)
        return [
            F.coalesce(scene, F.lit(False)).alias(f"scene_{name}"),
            F.coalesce(moved, F.lit(False)).alias(f"motion_{name}"),
        ]

    flagged = spread.select(
        "video_id", "chunk", "frame_idx", "_home", *compared(interval, "full"), *compared(half, "half")
    ).filter(F.col("_home") == F.col("chunk")).drop("_home")

    flagged = settle(flagged)  # four booleans a frame, read twice below
    tables = flagged.groupBy("video_id", "chunk").applyInPandas(
        _exits(interval, half, width),
        "video_id string, chunk long, enter_frame long, enter_kind int, enter_burst int,"
        "exit_frame long, exit_kind int, exit_burst int",
    )
    entries = tables.repartition("video_id").sortWithinPartitions("video_id", "chunk").mapInPandas(
        _chain(0), "video_id string, chunk long, enter_frame long, enter_kind int, enter_burst int"
    )
    # Sampled frames are few and read twice below, so the walk is written once.
    stepped = settle(flagged.join(entries, ["video_id", "chunk"]).groupBy("video_id", "chunk").applyInPandas(
        _emit(interval, half, width),
        "video_id string, frame_idx long, prev_frame long, scene boolean, burst int",
    ))
    return _with_last_frame(stepped, frames, scene_threshold, motion_threshold, hist, pixels)


def _with_last_frame(
    stepped: DataFrame, frames: DataFrame, scene_threshold: float, motion_threshold: float,
    hist: str, pixels: str,
) -> DataFrame:
    """Add each video's last frame where the steps miss it, compared with the last sample."""
    ends = frames.groupBy("video_id").agg(F.max("frame_idx").alias("frame_idx"))
    reached = stepped.groupBy("video_id").agg(
        F.max_by(F.struct(F.col("frame_idx").alias("prev_frame"), "burst"), "frame_idx").alias("s")
    )
    missed = ends.join(reached, "video_id").filter(F.col("frame_idx") > F.col("s.prev_frame")).select(
        "video_id", "frame_idx", "s.prev_frame", "s.burst"
    )
    tail = frames.select("video_id", "frame_idx", F.col(hist).alias("_h"), F.col(pixels).alias("_p"))
    before = tail.select(
        "video_id", F.col("frame_idx").alias("prev_frame"), F.col("_h").alias("_bh"), F.col("_p").alias("_bp")
    )
    left = F.greatest(F.col("burst") - 1, F.lit(0))
    moved = (left == 0) & (mean_abs_diff(F.col("_bp"), F.col("_p")) >= motion_threshold)
    added = (
        missed.join(tail, ["video_id", "frame_idx"]).join(before, ["video_id", "prev_frame"])
        .withColumn("scene", bhattacharyya(F.col("_bh"), F.col("_h")) > scene_threshold)
        .select(
            "video_id", "frame_idx", "prev_frame", "scene",
            F.when(F.col("scene") | moved, F.lit(BURST_SAMPLES)).otherwise(left).alias("burst"),
        )
    )
    return stepped.unionByName(added)


# ---- refinement ------------------------------------------------------------------------------

# Frames of a word of bits.
_WORD = 64


def _bits(low: Column, high: Column) -> Column:
    """Words (word, bits) that mark the frames from low to high; none where they cross or are null."""
    words = F.when((low <= high), F.sequence(F.floor(low / _WORD), F.floor(high / _WORD)))
    every = F.lit(-1).cast("long")

    def marked(word: Column) -> Column:
        first = F.greatest(low - word * _WORD, F.lit(0)).cast("int")
        last = F.least(high - word * _WORD, F.lit(_WORD - 1)).cast("int")
        return F.struct(word.alias("word"), F.call_function("shiftleft", F.call_function("shiftrightunsigned", every, F.lit(_WORD - 1) - (last - first)), first).alias("bits"))

    return F.transform(words, marked)


def boundary_frames(
    events: DataFrame, sampled: DataFrame, fps: Column, reach: int = BOUNDARY_FRAMES
) -> DataFrame:
    """Frames just outside event ranges that were not sampled yet.

    Frames travel as bits of words of 64, one or two words for each end of an event, and are told apart last.
    """
    start, end = (ms_to_frame(F.col(c), fps, "long") for c in ("start_ms", "end_ms"))
    none = F.lit(0).cast("long")
    wanted = events.select("video_id", F.explode(F.array(
        F.struct(F.greatest(start - reach, none).alias("low"), (start - 1).alias("high")),
        F.struct(F.greatest(end + 1, none).alias("low"), (end + reach).alias("high")),
    )).alias("run")).select("video_id", F.inline(_bits(F.col("run.low"), F.col("run.high")))).withColumn("seen", none)
    at = F.col("frame_idx").cast("long")
    seen = sampled.select("video_id", F.inline(_bits(at, at))).select("video_id", "word", none.alias("bits"), F.col("bits").alias("seen"))
    left = wanted.unionByName(seen).filter("video_id IS NOT NULL OR bits <> 0").groupBy("video_id", "word").agg(
        F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen")
    ).withColumn("left", F.col("bits").bitwiseAND(F.bitwise_not("seen"))).filter("left <> 0")
    places = F.filter(
        F.sequence(F.lit(0), F.lit(_WORD - 1)),
        lambda k: F.call_function("shiftrightunsigned", F.col("left"), k).bitwiseAND(F.lit(1).cast("long")) == 1,
    )
    return left.select("video_id", F.explode(places).alias("_k"), "word").select(
        "video_id", (F.col("word") * _WORD + F.col("_k")).cast("int").alias("frame_idx")
    )


def even_subsample(
    frames: DataFrame, budget: int = REFINE_BUDGET, minimum: int = REFINE_MINIMUM,
    chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """At most `budget` evenly spread frames per video; none where fewer than `minimum` remain."""
    placed = ranked(frames, ["video_id"], ["frame_idx"], "_rn", chunk_by("frame_idx", chunk_frames))
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("_n"))
    step = F.col("_n") / F.lit(float(budget))
    place = F.col("_rn") - 1
    near = F.floor(place / step).cast("int")
    # A place is taken when some slot i of the budget points at it; only slots next to place / step can.
    taken = F.exists(
        F.sequence(F.greatest(near - 1, F.lit(0)), F.least(near + 1, F.lit(budget - 1))),
        lambda i: F.floor(i * step) == place,
    )
    near_end = F.greatest(near - 1, F.lit(0)) <= F.least(near + 1, F.lit(budget - 1))
    return (
        placed.join(sizes, "video_id").filter(F.col("_n") >= minimum)
        .filter((F.col("_n") <= budget) | (near_end & taken)).drop("_rn", "_n")
    )
