"""Streams with custom state: linking and scene changes."""

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilmark.schemas import LINK_GAP_MS, LINK_TOLERANCE_PX, SCENE_THRESHOLD

EVENT_SCHEMA = (
    "video_id string, pii_type string, seed_ms long, seed_ord long, start_ms long, end_ms long,"
    "n_keyframes long, confidence double"
)
_OPEN = (
    "seed_ms:bigint,seed_ord:bigint,end_ms:bigint,cx:double,cy:double,n_keyframes:bigint,confidence:double"
)
_ROW = "time_ms:bigint,cand_ord:bigint,cx:double,cy:double,confidence:double,cut_ms:bigint"
# Arrived candidates that the watermark has not passed yet: pieces of time buckets, and an index of the buckets.
_WAITING = f"rows array<struct<{_ROW}>>"
_INDEX = "buckets array<struct<bucket:bigint,pieces:int,low:bigint>>"
# All about a key that is small, read and written as one value: when its next timer is due, its open events, waiting
# candidates while they are few, and the index of the buckets that hold them when they are many.
_STATE = f"due bigint, events array<struct<{_OPEN}>>, {_WAITING}, {_INDEX}"
_FEW_ROWS = 128


def _rocks(spark) -> None:
    """The state API needs the RocksDB state store."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


# Spark's first watermark stands at 1970 and rows up to it are late, a frame at 0 ms among them. Event times are therefore
# moved on by a century: rows from 1870 to 2162 count (pandas tells times to 2262).
_CENTURY_MS = 36_525 * 86_400_000


def _event_time(at: str) -> Column:
    """A timestamp as event time."""
    return F.timestamp_micros(F.unix_micros(at) + 1000 * _CENTURY_MS)


class _Linker(StatefulProcessor):
    """Open events of one video and kind, in order of opening.

    Arrived candidates wait until the watermark has passed them and are then taken in time order, so that rows that
    come late, but within the lateness, are linked as if they had come in order. An event is emitted once the
    watermark has passed its last keyframe by more than the gap.

    Few waiting rows lie with the open events, so that a key costs one read and one write a micro-batch. More lie in buckets
    as long as the gap. A micro-batch adds a piece to each of its buckets and rewrites none; a
    timer reads the pieces of buckets that are due, one bucket at a time, and of the others the small index only.
    """

    def __init__(self, gap_ms: int, tolerance: float, shift_ms: int = 0) -> None:
        self.gap_ms, self.width, self.reach, self.shift = gap_ms, max(gap_ms, 1), tolerance * tolerance, shift_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)
        self.waiting = handle.getMapState("waiting", "bucket bigint, piece int", _WAITING)

    def _take(self, bucket: int, pieces: int) -> list:
        """Rows of a bucket in order; its pieces are removed."""
        rows = []
        for piece in range(pieces):
            rows += [tuple(r) for r in self.waiting.getValue((bucket, piece))[0]]
            self.waiting.removeKey((bucket, piece))
        return sorted(rows, key=lambda r: r[:2])

    def _emit(self, key, events: list) -> pd.DataFrame:
        return pd.DataFrame(
            [(key[0], key[1], e[0], e[1], e[0], e[2], e[5], e[6]) for e in events],
            columns=["video_id", "pii_type", "seed_ms", "seed_ord", "start_ms", "end_ms", "n_keyframes",
                     "confidence"],
        )

    def _load(self) -> tuple[int | None, list, list, dict[int, tuple[int, int]]]:
        """When the next timer is due, the open events, the few rows and the buckets with their number of pieces and earliest time."""
        state = self.open.get()
        if state is None:
            return None, [], [], {}
        due, events, few, buckets = state
        return due, [list(e) for e in events or []], [tuple(r) for r in few or []], {b: (n, low) for b, n, low in buckets or []}

    def _store(self, due: int | None, held: list, few: list, buckets: dict[int, tuple[int, int]]) -> None:
        """Keep the state and have a timer at the time it wants; one that fires too early does no harm."""
        wanted = [e[2] + self.gap_ms + 1 for e in held] + [r[0] for r in few] + [low for _, low in buckets.values()]
        if not wanted and due is None:
            self.open.clear()
            return
        if wanted and (due is None or min(wanted) < due):
            due = min(wanted)
            self.handle.registerTimer(due + self.shift)
        self.open.update((due, [tuple(e) for e in held], few, [(b, n, low) for b, (n, low) in sorted(buckets.items())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due, held, few, buckets = self._load()
        for chunk in rows:  # a part of the micro-batch at a time
            cuts = chunk["last_cut_ms"] if "last_cut_ms" in chunk else [None] * len(chunk)
            few += [
                (int(t), int(o), float(x + w / 2), float(y + h / 2), float(c), None if pd.isna(cut) else int(cut))
                for t, o, x, y, w, h, c, cut in zip(*(chunk[n] for n in ("time_ms", "cand_ord", "x", "y", "w", "h", "confidence")), cuts)
            ]
            if len(few) <= _FEW_ROWS:
                continue
            parts = {}
            for row in few:
                parts.setdefault(row[0] // self.width, []).append(row)
            for bucket, part in parts.items():
                pieces, early = buckets.get(bucket, (0, part[0][0]))
                self.waiting.updateValue((bucket, pieces), (part,))
                buckets[bucket] = (pieces + 1, min(early, *(r[0] for r in part)))
            few = []
        self._store(due, held, few, buckets)
        yield from ()

    def _walk(self, held: list, rows: list) -> list:
        """Link rows in order; returns the events that were closed on the way."""
        closed = []
        for at, order, cx, cy, confidence, cut in rows:
            closed += [e for e in held if at - e[2] > self.gap_ms]
            held[:] = [e for e in held if at - e[2] <= self.gap_ms]
            for e in held:
                if (cut is None or cut <= e[2]) and (cx - e[3]) ** 2 + (cy - e[4]) ** 2 <= self.reach:
                    e[2:] = [at, cx, cy, e[5] + 1, max(e[6], confidence)]
                    break
            else:
                held.append([at, order, at, cx, cy, 1, confidence])
        return closed

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() - self.shift
        _, held, few, buckets = self._load()
        done, due, later = [], {}, []
        for row in few:
            if row[0] <= now:
                due.setdefault(row[0] // self.width, []).append(row)
            else:
                later.append(row)
        for bucket in sorted({b for b, (_, low) in buckets.items() if low <= now} | due.keys()):
            rows = self._take(bucket, buckets.pop(bucket)[0]) if bucket in buckets and buckets[bucket][1] <= now else []
            n_due = sum(r[0] <= now for r in rows)
            done += self._walk(held, sorted(rows[:n_due] + due.get(bucket, []), key=lambda r: r[:2]))
            if n_due < len(rows):
                self.waiting.updateValue((bucket, 0), (rows[n_due:],))
                buckets[bucket] = (1, rows[n_due][0])
        done += [e for e in held if e[2] + self.gap_ms < now]
        held = [e for e in held if e[2] + self.gap_ms >= now]
        self._store(None, held, later, buckets)
        if done:
            yield self._emit(key, done)

    def close(self) -> None:
        pass


def stream_link(
    candidates: DataFrame, at: str, gap_ms: int = LINK_GAP_MS, tolerance_px: float = LINK_TOLERANCE_PX,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Link arriving candidates as the batch does; only rows later than the lateness are dropped.

    `time_ms` is the time `at` in milliseconds. With a column `last_cut_ms` (the last scene cut before the candidate, or
    null) no candidate joins an event that ended before that cut.
    """
    _rocks(candidates.sparkSession)
    needed = ["video_id", "pii_type", "time_ms", "cand_ord", *"xywh", "confidence", *(c for c in ["last_cut_ms"] if c in candidates.columns)]
    return (
        candidates.select(*needed, _event_time(at).alias("_at")).withWatermark("_at", lateness).groupBy("video_id", "pii_type")
        .transformWithStateInPandas(
            _Linker(gap_ms, float(tolerance_px), _CENTURY_MS), EVENT_SCHEMA, outputMode="append", timeMode="eventTime"
        )
    )


class _SceneWatch(StatefulProcessor):
    """The last histogram of a video."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame_idx int, hist array<double>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("frame_idx")
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for frame, hist in zip(frames["frame_idx"], frames["hist"]):
            now = np.asarray(hist, dtype=float)
            if before is not None:
                then = np.asarray(before[1], dtype=float)
                shared, mass = np.sqrt(then * now).sum(), np.sqrt(then.sum() * now.sum())
                far = float(np.sqrt(max(0.0, 1 - (shared / mass if mass > 0 else shared))))
                if far > self.threshold:
                    out.append((key[0], int(before[0]), int(frame), far))
            before = (int(frame), now)
        self.last.update((before[0], [float(v) for v in before[1]]))
        if out:
            yield pd.DataFrame(out, columns=["video_id", "prev_frame", "frame_idx", "distance"])

    def close(self) -> None:
        pass


class _TimedSceneWatch(StatefulProcessor):
    """Scene changes in order of time, however late frames arrive within the lateness.

    Frames wait in pieces of time buckets until the watermark has passed them. One timer a video stands at its earliest
    waiting frame; it reads the pieces of the buckets that are due and of the others a small index. A video without a
    frame for `idle_ms` of event time is forgotten.
    """

    def __init__(self, threshold: float, idle_ms: int, bucket_ms: int = 60_000) -> None:
        self.threshold, self.idle_ms, self.width = threshold, idle_ms, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "time_ms bigint, frame_idx int, hist array<double>")
        self.index = handle.getValueState("index", f"due bigint, {_INDEX}")
        self.waiting = handle.getMapState("waiting", "bucket bigint, piece int", "frames array<struct<time_ms:bigint,frame_idx:int,hist:array<double>>>")

    def _load(self) -> tuple[int | None, dict[int, tuple[int, int]]]:
        if not self.index.exists():
            return None, {}
        due, buckets = self.index.get()
        return due, {b: (n, low) for b, n, low in buckets or []}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due, buckets = self._load()
        for chunk in rows:  # a part of the micro-batch at a time
            parts = {}
            for at, frame, hist in zip(chunk["time_ms"], chunk["frame_idx"], chunk["hist"]):
                if hist is not None:
                    parts.setdefault(int(at) // self.width, []).append((int(at), int(frame), [float(v) for v in hist]))
            for bucket, part in parts.items():
                early = min(r[0] for r in part)
                pieces, low = buckets.get(bucket, (0, early))
                self.waiting.updateValue((bucket, pieces), (part,))
                buckets[bucket] = (pieces + 1, min(low, early))
        if buckets:
            wanted = min(low for _, low in buckets.values())
            if due is None or wanted < due:
                due = wanted
                self.handle.registerTimer(due)
            self.index.update((due, [(b, n, low) for b, (n, low) in sorted(buckets.items())]))
        yield from ()

    def _frames(self, buckets: dict[int, tuple[int, int]], now: int) -> Iterator[tuple]:
        """Frames that are due, in order and without repeats; the others of their buckets stay."""
        for bucket in sorted(b for b, (_, low) in buckets.items() if low <= now):
            frames = {}
            for piece in range(buckets.pop(bucket)[0]):
                frames |= {(r[0], r[1]): r[2] for r in self.waiting.getValue((bucket, piece))[0]}
                self.waiting.removeKey((bucket, piece))
            later = [(*place, frames[place]) for place in sorted(frames) if place[0] > now]
            if later:
                self.waiting.updateValue((bucket, 0), (later,))
                buckets[bucket] = (1, later[0][0])
            yield from ((*place, np.asarray(frames[place], dtype=float)) for place in sorted(frames) if place[0] <= now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, buckets = self._load()
        before, seen, out = tuple(self.last.get()) if self.last.exists() else None, False, []
        for place in self._frames(buckets, now):
            if before is not None and place[0] - before[0] > self.idle_ms:
                before = None
            if before is not None:
                then, hist = np.asarray(before[2], dtype=float), place[2]
                shared, mass = np.sqrt(then * hist).sum(), np.sqrt(then.sum() * hist.sum())
                far = float(np.sqrt(max(0.0, 1 - (shared / mass if mass > 0 else shared))))
                if far > self.threshold:
                    out.append((key[0], int(before[1]), int(place[1]), far))
            before, seen = place, True
        if before is not None and before[0] + self.idle_ms < now:
            self.last.clear()
            before = None
        elif seen:
            self.last.update((before[0], before[1], [float(v) for v in before[2]]))
        due = min([low for _, low in buckets.values()] + ([before[0] + self.idle_ms + 1] if before is not None else []), default=None)
        if due is None:
            self.index.clear()
        else:
            self.handle.registerTimer(due)
            self.index.update((due, [(b, n, low) for b, (n, low) in sorted(buckets.items())]))
        if out:
            yield pd.DataFrame(out, columns=["video_id", "prev_frame", "frame_idx", "distance"])

    def close(self) -> None:
        pass


def stream_timed_scene_changes(
    hists: DataFrame, at: str, threshold: float = SCENE_THRESHOLD, lateness: str = "10 minutes", idle_ms: int = 3_600_000,
) -> DataFrame:
    """Scene changes of frames (video_id, frame_idx, hist) by their event time `at`, equal to those of the batch.

    Frames may arrive in any order within the lateness; later ones are dropped. Frames of equal time go by frame_idx, of
    frames that repeat both one counts, and one without a histogram or a time is passed over. After `idle_ms` without a frame a video is
    forgotten: its next frame is a first one.
    """
    _rocks(hists.sparkSession)
    timed = hists.where(F.col(at).isNotNull()).select(
        "video_id", F.col("frame_idx").cast("int").alias("frame_idx"), "hist", _event_time(at).alias("_at")
    ).withColumn("time_ms", F.unix_millis("_at"))
    return timed.withWatermark("_at", lateness).groupBy("video_id").transformWithStateInPandas(
        _TimedSceneWatch(threshold, idle_ms), "video_id string, prev_frame int, frame_idx int, distance double",
        outputMode="append", timeMode="eventTime",
    )


def stream_scene_changes(hists: DataFrame, threshold: float = SCENE_THRESHOLD) -> DataFrame:
    """Scene changes of arriving frames; frames of a video arrive in order."""
    _rocks(hists.sparkSession)
    return hists.select("video_id", "frame_idx", F.col("hist")).groupBy("video_id").transformWithStateInPandas(
        _SceneWatch(threshold), "video_id string, prev_frame int, frame_idx int, distance double",
        outputMode="append", timeMode="None",
    )
