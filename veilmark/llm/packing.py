"""Order-preserving packing by dynamic programming: where to cut the stream of frame texts into windows.

A window ends at a frame's end, a sentence's end or, in sentences longer than `HARD_STEP` ids, inside one. The cost
of a window is its padding and the penalty of its end; the best predecessor of an end is the front of a monotone
queue, so that each end is handled in constant time. Windows whose length is a power of two need no padding.
"""

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from veilmark.llm import tokens
from veilmark.llm import words as W

LENGTH = 1024
RUN_TOKENS = 1 << 20
HARD_STEP = 64
SENTENCE_PENALTY = 3.0
HARD_PENALTY = 24.0
WINDOW_COST = 1.0
LEAST_POWER = 64


def cut_windows(ends: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The ends at which windows end, ascending, the last end included.

    ends: ascending positions, none more than `length` behind the one before (0 at first). Minimises over all choices
    the sum of padding, penalties and WINDOW_COST a window.
    """
    at = np.concatenate([[0], ends])
    powers = []
    size = length >> 1
    while size >= min(LEAST_POWER, length):
        place = np.searchsorted(at, at - size)
        powers.append(np.where(at[np.minimum(place, len(at) - 1)] == at - size, place, -1))
        size >>= 1
    exact: dict[int, list[int]] = {}  # the few ends that lie a power of two behind another one
    for found in powers:
        for j in np.flatnonzero(found >= 0).tolist():
            exact.setdefault(j, []).append(int(found[j]))
    at, penalty = at.tolist(), [0.0, *penalty.tolist()]
    cost, origin, key = [0.0] * len(at), [0] * len(at), [0.0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        best = key[i] + length - here
        if j in exact:
            for k in exact[j]:
                if cost[k] < best:
                    i, best = k, cost[k]
        best += penalty[j] + WINDOW_COST
        cost[j], origin[j], key[j] = best, i, best + here
        while queue and key[queue[-1]] >= best + here:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = origin[j]
    return out[::-1]


def possible_ends(ids: np.ndarray, frame_ends: np.ndarray, closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind which a window may end, and their penalties. closes: by id, whether it ends a sentence."""
    kind = np.zeros(len(ids) + 1, np.int8)
    kind[1:][closes[ids]] = 1
    kind[frame_ends] = 2
    places = np.flatnonzero(kind)
    gaps = np.diff(places, prepend=0)
    wide = np.flatnonzero(gaps > HARD_STEP)
    if len(wide):
        extra = (gaps[wide] - 1) // HARD_STEP
        first = np.repeat(places[wide] - gaps[wide], extra)
        steps = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        kind[first + steps * HARD_STEP] = 3
        places = np.flatnonzero(kind)
    return places, np.array([0.0, SENTENCE_PENALTY, 0.0, HARD_PENALTY])[kind[places]]


def sentence_closers(tool: tokens.ChunkTokenizer) -> np.ndarray:
    """By id: whether the token ends in . ! ? or a line feed."""
    out = np.zeros(max(tool.size, tool.end_id + 1), bool)
    for text, ident in tool.tokenizer.get_vocab().items():
        out[ident] = text.endswith((".", "!", "?", "Ċ"))
    return out


def pack_frames(frames: DataFrame, tokenizer: str, kind: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Pack the ids of all frame texts into sequences of at most `length` ids, in ascending frame_idx order.

    frames: frame_idx (long), composite; other columns are ignored. Null text counts as empty: its frame is the end
    id alone. Rows without frame_idx come first; repeated rows are packed each. Returns a row per piece: frame_idx,
    start (its frame's ids before it), length, ids_crc32 (of little-endian unsigned 32-bit ids), frame_tokens,
    sequence_id, offset (in its sequence, gapless from 0). `length` is a power of two.

    Each range of frames is packed by one task in runs of about RUN_TOKENS ids; the last window of a run is opened
    again in the next one, so that only a task's end leaves a window that is not chosen freely.
    """
    columns = "frame_idx long, start long, length long, ids_crc32 long, frame_tokens long, sequence_id long, offset long"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens.tool(tokenizer, kind, end_id)
        closes = sentence_closers(tool)
        sequence = TaskContext.get().partitionId() << 40
        ids = [np.zeros(0, np.uint32)]
        owner: list[tuple[int | None, int, int]] = []  # frame_idx, its ids before this run, its ids in all
        here: list[int] = []  # ids of each owner in this run

        def settle_run(last: bool) -> pa.RecordBatch | None:
            nonlocal sequence
            run = np.concatenate(ids)
            frame_ends = np.cumsum(here)
            cuts = cut_windows(*possible_ends(run, frame_ends, closes), length)
            if not last:
                cuts = cuts[:-1]
            stop = cuts[-1] if cuts else 0
            bounds = np.union1d(np.concatenate([[0], cuts]), frame_ends[frame_ends < stop]).astype(np.int64)
            begin, size = bounds[:-1], np.diff(bounds)
            frame = np.searchsorted(frame_ends, begin, "right")
            window = np.searchsorted(cuts, begin, "right")
            first = np.concatenate([[0], frame_ends])[frame]
            body = memoryview(run[:stop].astype("<u4").tobytes())
            out = pa.record_batch({
                "frame_idx": pa.array([owner[f][0] for f in frame.tolist()], pa.int64()),
                "start": pa.array(begin - first + np.array([owner[f][1] for f in frame.tolist()], np.int64), pa.int64()),
                "length": pa.array(size, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.int64()),
                "frame_tokens": pa.array([owner[f][2] for f in frame.tolist()], pa.int64()),
                "sequence_id": pa.array(sequence + window, pa.int64()),
                "offset": pa.array(begin - np.concatenate([[0], cuts]).astype(np.int64)[window], pa.int64()),
            })
            sequence += len(cuts)
            kept = int(np.searchsorted(frame_ends, stop, "right"))
            cut_off = stop - (int(frame_ends[kept - 1]) if kept else 0)
            del owner[:kept], here[:kept]
            if owner:
                owner[0] = (owner[0][0], owner[0][1] + cut_off, owner[0][2])
                here[0] -= cut_off
            ids[:] = [run[stop:]]
            return out

        held = 0
        for whole in batches:
            for batch in W.slices(whole, "composite"):
                some, bounds = tool.encode(batch.column("composite").to_pylist())
                ids.append(some)
                sizes = np.diff(bounds).tolist()
                here += sizes
                owner += [(f, 0, n) for f, n in zip(batch.column("frame_idx").to_pylist(), sizes)]
                held += len(some)
                if held >= RUN_TOKENS:
                    yield settle_run(False)
                    held = 0
        if owner:
            yield settle_run(True)

    return (
        frames.selectExpr("CAST(frame_idx AS LONG) AS frame_idx", "composite")
        .repartitionByRange("frame_idx").sortWithinPartitions("frame_idx", "composite").mapInArrow(pack, columns)
    )
