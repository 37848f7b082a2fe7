"""Ranked search the other way round: an inverted index of the searched texts meets each frame's term counts.

Frames are many, the findings whose texts are searched are few: an index over the findings' terms is sent to all tasks, each frame's term
counts stream through it, and every task keeps the best frames of each finding in a bounded heap. The heaps meet at last.
"""

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.llm import words as W
from veilmark.plans.session import settle

FRAME = ["video_id", "frame_idx"]
TOP = 10
BLOCK_POSTINGS = 200_000
BLOCK_FINDINGS = 10_000
BLOCK_CELLS = 1 << 20
TEXT_BYTES = 1 << 20
SALTS = 64
# ---- fixed values: the score's weights --------------------------------------------------------
SCALE, LENGTH_SHARE, SATURATION = 1000, 90, 8
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


class Index(NamedTuple):
    """Numbers of the terms, and for each term the findings (by number) that hold it."""

    terms: dict[bytes, int]
    starts: np.ndarray
    findings: np.ndarray
    ids: list


def _count_terms(body: bytes, keep) -> Counter:
    """Counts of keep(term) over a text in which all but the terms is blank already; a long text goes in pieces."""
    if len(body) <= TEXT_BYTES:
        return Counter(map(keep, body.split()))
    out, at = Counter(), 0
    while at < len(body):
        end = body.find(b" ", at + TEXT_BYTES)
        end = len(body) if end < 0 else end
        out.update(map(keep, body[at:end].split()))
        at = end
    return out


def _bodies(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The texts of a batch as bytes, terms in lower case and blanks between them; a null text is empty."""
    data, offsets = W.utf8(batch.column(column))
    flat = data.tobytes().translate(_TERM_BYTES)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield flat[a:b]


def finding_terms(findings: DataFrame) -> DataFrame:
    """The distinct terms of each finding: event_id, term."""
    schema = T.StructType([findings.schema["event_id"], T.StructField("term", T.BinaryType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "extracted_text"):
                terms = [sorted(_count_terms(body, bytes)) for body in _bodies(batch, "extracted_text")]
                owner = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
                yield pa.RecordBatch.from_arrays([batch.column("event_id").take(pa.array(owner)), pa.array([t for some in terms for t in some], pa.binary())], names=["event_id", "term"])

    return findings.select("event_id", "extracted_text").mapInArrow(split, schema).distinct()


def _index(terms: DataFrame) -> Index:
    """The inverted index of a block of findings, about BLOCK_POSTINGS rows."""
    ids: dict = {}
    known: dict[bytes, int] = {}
    pairs = [(known.setdefault(bytes(r["term"]), len(known)), ids.setdefault(r["event_id"], len(ids))) for r in terms.collect()]
    order = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    starts = np.searchsorted(order[:, 0], np.arange(len(known) + 1))
    return Index(known, starts, order[:, 1].copy(), list(ids))


def _term_counts(frames: DataFrame, index: Broadcast) -> DataFrame:
    """One pass over the texts. Per frame with an indexed term: n_terms (all its terms), terms and counts of the
    indexed ones. Per task: rows (term, holders), the number of its frames that hold the term; term -1 stands
    for frames with any term, -2 for their terms with repeats."""
    fields = T.StructType([*frames.select(*FRAME).schema.fields, *[
        T.StructField(n, t) for n, t in (("n_terms", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("counts", T.ArrayType(T.LongType())), ("term", T.IntegerType()), ("holders", T.LongType()))
    ]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.terms
        holders = np.zeros(len(known), np.int64)
        with_terms = all_terms = 0
        for whole in batches:
            for batch in W.slices(whole, "composite"):
                row, size, terms, counts = [], [], [], []
                for i, body in enumerate(_bodies(batch, "composite")):
                    found = _count_terms(body, known.get)
                    n = sum(found.values())
                    if n:
                        with_terms += 1
                        all_terms += n
                        found.pop(None, None)
                        if found:
                            row.append(i)
                            size.append(n)
                            terms.append(list(found))
                            counts.append(list(found.values()))
                if row:
                    holders += np.bincount(np.concatenate(terms), minlength=len(known))
                    some = batch.select(FRAME).take(pa.array(row))
                    none = pa.nulls(len(row))
                    yield pa.RecordBatch.from_arrays([
                        *some.columns, pa.array(size, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())),
                        none.cast(pa.int32()), none.cast(pa.int64()),
                    ], names=fields.names)
        if with_terms:
            seen = np.flatnonzero(holders)
            term, n = [-1, -2, *seen.tolist()], [with_terms, all_terms, *holders[seen].tolist()]
            none = {c: pa.nulls(len(term), t) for c, t in zip(fields.names[:5], [batch.column(c).type for c in FRAME] + [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())])}
            yield pa.record_batch(none | {"term": pa.array(term, pa.int32()), "holders": pa.array(n, pa.int64())})

    return frames.mapInArrow(count, fields)


def _best(rows: list[tuple], top: int) -> list[tuple]:
    """The best (score, video_id, frame_idx), highest score first, then by frame_idx and video_id, null last."""
    return sorted(rows, key=lambda r: (-r[0], *_place(r[1], r[2])))[:top]


def _place(video, frame) -> tuple:
    return (frame is None, 0 if frame is None else frame, video is None, "" if video is None else video)


def _blocks(whole: pa.RecordBatch, starts: np.ndarray, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[int], list[tuple]]]:
    """Rows of a batch in blocks of about BLOCK_CELLS scores and postings, with the order of their keys.

    Yields the block, the place of each row in the order, the row at each place, and the keys.
    """
    lists = whole.column("terms")
    spread = np.concatenate([[0], np.cumsum((starts[1:] - starts[:-1])[lists.flatten().to_numpy()])])
    bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy())])
    load = np.maximum(spread[bounds], width * np.arange(whole.num_rows + 1))
    at = 0
    while at < whole.num_rows:
        end = max(at + 1, int(np.searchsorted(load, load[at] + BLOCK_CELLS, "right")) - 1)
        batch = whole.slice(at, end - at)
        keys = list(zip(batch.column("video_id").to_pylist(), batch.column("frame_idx").to_pylist()))
        order = sorted(range(len(keys)), key=lambda i: _place(*keys[i]))
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        yield batch, place, order, keys
        at = end


def _heaps(counted: DataFrame, index: Broadcast, weights: Broadcast, n_frames: int, n_terms: int, top: int) -> DataFrame:
    """The best frames of each finding within each task: finding (its number), video_id, frame_idx, score."""
    fields = T.StructType([T.StructField("finding", T.IntegerType()), *counted.select(*FRAME).schema.fields, T.StructField("score", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, starts, findings, ids = index.value
        width, weight = len(ids), weights.value
        heaps: dict[int, list[tuple]] = {}
        least = np.ones(width)  # a score must reach it
        kinds = None
        for whole in batches:
            kinds = [whole.column(c).type for c in FRAME]
            for batch, place, order, keys in _blocks(whole, starts, width):
                length = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * n_frames // n_terms for n in batch.column("n_terms").to_pylist()], np.int64)
                terms, counts = batch.column("terms"), batch.column("counts")
                owner = np.repeat(np.arange(len(keys)), pa.compute.list_value_length(terms).to_numpy())
                term, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy()
                part = weight[term] * ((1_000_000 * SCALE * tf) // (SCALE * tf + SATURATION * length[owner]))
                some = np.flatnonzero(part)
                spread = (starts[1:] - starts[:-1])[term[some]]
                before = np.cumsum(spread) - spread
                posting = findings[np.repeat(starts[term[some]] - before, spread) + np.arange(spread.sum())]
                cell = np.repeat(place[owner[some]] * width, spread) + posting
                # sums of whole numbers below 2^53 are exact in doubles
                score = np.bincount(cell, np.repeat(part[some], spread), len(keys) * width).reshape(len(keys), width)
                for k in np.flatnonzero((score >= least).any(axis=0)).tolist():
                    high = np.flatnonzero(score[:, k] >= least[k])
                    high = high[np.argsort(-score[high, k], kind="stable")][:top]
                    new = [(int(score[i, k]), *keys[order[i]]) for i in high.tolist()]
                    heaps[k] = _best(heaps.get(k, []) + new, top)
                    if len(heaps[k]) == top:
                        least[k] = max(1, heaps[k][-1][0])
        rows = [(k, *r) for k, heap in heaps.items() for r in heap]
        if rows:
            finding, score, video, frame = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(finding, pa.int32()), pa.array(video, kinds[0]), pa.array(frame, kinds[1]), pa.array(score, pa.int64())], names=fields.names)

    return counted.mapInArrow(search, fields)


def _merged(heaps: DataFrame, top: int) -> DataFrame:
    """The best of all heaps, in two steps so that no finding's heaps of all tasks meet in one task."""
    order = [F.desc("score"), F.asc_nulls_last("frame_idx"), F.asc_nulls_last("video_id")]
    salted = heaps.withColumn("salt", F.pmod(F.xxhash64(*FRAME), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("finding", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("finding").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def rank_frames(findings: DataFrame, frames: DataFrame, top: int = TOP, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The `top` frames that fit each finding's text best.

    findings: event_id, extracted_text; frames: video_id, frame_idx, composite; other columns are ignored. Terms are
    longest runs of A-Z, a-z, 0-9 and characters from U+0080 on in the whole text, A-Z as a-z. With N frames that have a term, L
    terms in all of them, df frames holding a term, tf times in the frame, n terms in the frame: a term weighs
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), the frame has m = 10 + (90 n N div L), and its score is the sum of w * (10^9 tf div (1000 tf +
    8 m)) over the distinct terms of the finding. Returns event_id, rank (from 1), video_id, frame_idx, score for
    scores above 0, ties by frame_idx, then video_id, null last.

    Rows that share an event_id, null too, are one finding with the terms of all; texts without a term (null, empty)
    find nothing. Frames that repeat a key are ranked each. Empty tables give no rows.

    The index holds about `block_postings` pairs of term and finding; more findings are searched in blocks, each
    against all frames.
    """
    spark = frames.sparkSession
    asked = settle(finding_terms(findings))
    postings, n_findings = asked.count(), asked.select("event_id").distinct().count()
    schema = T.StructType([findings.schema["event_id"], T.StructField("rank", T.IntegerType()), *frames.select(*FRAME).schema.fields, T.StructField("score", T.LongType())])
    if not postings:
        return spark.createDataFrame([], schema)
    blocks = max(-(-postings // block_postings), -(-n_findings // BLOCK_FINDINGS))
    base = frames.select(*FRAME, "composite")
    found = []
    for block in range(blocks):
        index = _index(asked.where(F.pmod(F.xxhash64("event_id"), F.lit(blocks)) == block))
        if not index.terms:
            continue
        shared = spark.sparkContext.broadcast(index)
        counted = settle(_term_counts(base, shared))
        # one row a term of the block
        holders = dict(map(tuple, counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("holders")).collect()))
        n_frames, n_terms = holders.get(-1, 0), holders.get(-2, 0)
        weights = np.array([math.floor(SCALE * math.log((2 * n_frames + 2) / (2 * holders.get(t, 0) + 1))) for t in range(len(index.terms))], np.int64)
        heaps = _heaps(counted.where("term IS NULL"), shared, spark.sparkContext.broadcast(weights), n_frames, n_terms, top)
        ids = spark.createDataFrame([(i, e) for i, e in enumerate(index.ids)], T.StructType([T.StructField("finding", T.IntegerType()), findings.schema["event_id"]]))
        found.append(settle(_merged(heaps, top).join(F.broadcast(ids), "finding").select(*schema.names)))  # BLOCK_FINDINGS rows
    out = found[0] if found else spark.createDataFrame([], schema)
    for more in found[1:]:
        out = out.union(more)
    return out
