"""Exact top-k search by inner product with a pivot-distance index.

Vectors are whole numbers. With one more component that makes all of them equally long, the largest inner product
is the smallest distance. Each vector is keyed by its nearest pivot and its distance to it; the distances are cut
into rings. The triangle inequality bounds how near a ring can come to a query, so rings are visited from the
nearest one on, and a query stops where no ring can still beat its k-th score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.plans.session import settle

K = 5
PIVOTS = 24
RINGS = 8
SAMPLE = 4096
SHARD_ROWS = 4096
QUERY_BLOCK = 512
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Centres of the sample by a few rounds of Lloyd's rule from far-apart starts."""
    sample = np.unique(sample, axis=0)
    chosen = [sample[0]]
    gap = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(sample[gap.argmax()])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(axis=1))
    pivots = np.array(chosen)
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(axis=1)
        pivots = np.array([sample[near == p].mean(axis=0) if (near == p).any() else pivots[p] for p in range(len(pivots))])
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None], 0.0))


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, so that all vectors are `longest` long."""
    return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))[:, None]])


def _index(vectors: DataFrame, pivots: np.ndarray, edges: np.ndarray, longest: float, size: int) -> DataFrame:
    """Each vector with its pivot, ring and distance."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = distances(_lifted(_matrix(batch.column("v"), size), longest), pivots)
                near = gap.argmin(axis=1)
                gap = gap[np.arange(len(near)), near]
                ring = (gap[:, None] > edges[near]).sum(axis=1)
                yield pa.record_batch({"frame_idx": batch.column("frame_idx"), "v": batch.column("v"), "pivot": pa.array(near.astype(np.int32)),
                                       "ring": pa.array(ring.astype(np.int32)), "gap": pa.array(gap)})

    return vectors.mapInArrow(place, "frame_idx long, v binary, pivot int, ring int, gap double")


def _score(pairs: DataFrame, size: int, k: int) -> DataFrame:
    """The k best of each shard for each query of a block: query_id, frame_idx, score. One pair of blocks at a time.

    Within a pair, queries whose k-th score the shard's own bounds cannot beat are left out.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), size)
                asked = np.frombuffer(row["q_ids"], np.int64)
                q = np.frombuffer(row["q_vectors"], np.float64).reshape(len(asked), size)
                value = q @ x.T
                value[asked[:, None] == ids[None]] = -np.inf
                least = np.frombuffer(row["q_least"], np.float64)
                some = min(k, len(ids))
                rank = np.lexsort((np.broadcast_to(ids, value.shape), -value), axis=1)[:, :some] if len(ids) <= 4 * k else _best(value, ids, some)
                best = np.take_along_axis(value, rank, axis=1)
                good = np.isfinite(best) & (best >= least[:, None])
                yield pa.record_batch({
                    "query_id": pa.array(np.repeat(asked, some)[good.ravel()]), "frame_idx": pa.array(ids[rank][good]),
                    "score": pa.array(best[good].astype(np.int64)),
                })

    return pairs.mapInArrow(score, "query_id long, frame_idx long, score long")


def _best(value: np.ndarray, ids: np.ndarray, some: int) -> np.ndarray:
    """Columns of the highest values of each row, ties to smaller ids; ids ascend."""
    cut = -np.partition(-value, some - 1, axis=1)[:, some - 1 : some]
    above = value > cut
    tied = value == cut
    room = some - above.sum(axis=1, keepdims=True)
    take = above | (tied & (np.cumsum(tied, axis=1) <= room))
    columns = np.nonzero(take)[1].reshape(len(value), some)
    return np.take_along_axis(columns, np.argsort(-np.take_along_axis(value, columns, axis=1), axis=1, kind="stable"), axis=1)


def _packed(rows: DataFrame, keys: list[str], names: dict[str, str], extra: str | None = None) -> DataFrame:
    """One row per key with its ids and vectors as bytes; a key holds a bounded number of rows."""
    kept = ["frame_idx", "v"] + ([extra] if extra else [])
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("all"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, items in enumerate(batch.column("all").to_pylist()):
                out = {k: batch.column(k).slice(i, 1) for k in keys}
                out[names["ids"]] = pa.array([np.array([r["frame_idx"] for r in items], np.int64).tobytes()])
                out[names["vectors"]] = pa.array([b"".join(r["v"] for r in items)])
                if extra:
                    out[names["extra"]] = pa.array([np.array([r[extra] for r in items], np.float64).tobytes()])
                yield pa.record_batch(out)

    types = ", ".join(f"{k} {dict(grouped.dtypes)[k]}" for k in keys) + ", " + ", ".join(f"{n} binary" for n in names.values())
    return grouped.mapInArrow(pack, types)


def nearest_frames(frames: DataFrame, queries: DataFrame, k: int = K, scale: int = 256) -> DataFrame:
    """The k frames with the highest score for each query frame: query_id, rank (from 1), frame_idx, score.

    frames and queries: frame_idx (long, unique), hist (array of numbers). Each component becomes
    floor(scale * x); the score is the integer inner product; ties go to the smaller frame_idx; a frame is no
    answer to its own query. A hist that is null or empty, or holds null or non-finite numbers, takes no part, as
    does a null frame_idx or a length other than the commonest (the longest of equally common ones).
    Fewer candidates than k give fewer rows; repeated rows of a frame_idx count once.
    Scores are exact while they stay below 2^53.

    Pivots are fitted on at most SAMPLE vectors; every vector is indexed. The rings' bounds, PIVOTS x RINGS rows, go to
    every task. Shards of about SHARD_ROWS vectors meet blocks of at most about QUERY_BLOCK queries in three rounds: the nearest
    ring, the next rings that may beat the k-th score, and the rest that still may. Nothing else is pruned.
    """
    sound = "hist IS NOT NULL AND size(hist) > 0 AND frame_idx IS NOT NULL AND forall(hist, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"

    def whole(df: DataFrame) -> DataFrame:
        return df.select(F.col("frame_idx").cast("long").alias("frame_idx"), F.col("hist").cast("array<double>").alias("hist")).where(sound)

    usual = whole(frames).groupBy(F.size("hist").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    spark = frames.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, frame_idx long, score long")
    if usual is None:
        return nothing
    size = usual["n"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * np.array(batch.column("hist").to_pylist(), np.float64).reshape(-1, size))
            yield pa.record_batch({"frame_idx": batch.column("frame_idx"), "v": pa.array([r.tobytes() for r in x], pa.binary()), "len2": pa.array((x * x).sum(axis=1))})

    def encoded(df: DataFrame) -> DataFrame:
        one = whole(df).where(F.size("hist") == size).groupBy("frame_idx").agg(F.min("hist").alias("hist"))
        return one.mapInArrow(encode, "frame_idx long, v binary, len2 double")

    vectors = settle(encoded(frames))
    longest = vectors.agg(F.max("len2")).first()[0]
    if longest is None:
        return nothing
    some = vectors.select("frame_idx", "v").orderBy(F.xxhash64("frame_idx"), "frame_idx").limit(SAMPLE).collect()  # SAMPLE vectors
    sample = _lifted(np.frombuffer(b"".join(r["v"] for r in some), np.float64).reshape(-1, size), longest)
    pivots = choose_pivots(sample)
    gap = distances(sample, pivots)
    near = gap.argmin(axis=1)
    gap = gap[np.arange(len(near)), near]
    edges = np.array([np.quantile(gap[near == p], np.arange(1, RINGS) / RINGS) if (near == p).any() else np.zeros(RINGS - 1) for p in range(len(pivots))])
    placed = settle(_index(vectors.select("frame_idx", "v"), pivots, edges, longest, size))
    rings = placed.groupBy("pivot", "ring").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n"))
    rings = rings.withColumn("shards", F.ceil(F.col("n") / SHARD_ROWS).cast("int"))
    bounds = rings.collect()  # PIVOTS x RINGS rows at most
    shards = (
        placed.join(F.broadcast(rings.select("pivot", "ring", "shards")), ["pivot", "ring"])
        .withColumn("shard", F.pmod(F.xxhash64("frame_idx"), F.col("shards")).cast("int"))
    )
    store = settle(_packed(shards, ["pivot", "ring", "shard"], {"ids": "ids", "vectors": "vectors"}))
    pivot_of = np.array([r["pivot"] for r in bounds])
    ring_of = np.array([r["ring"] for r in bounds])
    low, high = np.array([r["low"] for r in bounds]), np.array([r["high"] for r in bounds])
    count = [r["shards"] for r in bounds]
    asked = settle(encoded(queries))

    def plan(todo: DataFrame, first: int, last: int | None) -> DataFrame:
        """The rings that each query visits in a round: from place `first` to `last` in the order of their bounds."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                q = np.hstack([_matrix(batch.column("v"), size), np.zeros((n, 1))])
                away = distances(q, pivots)[:, pivot_of]
                bound = np.maximum(np.maximum(low[None] - away, away - high[None]), 0.0)
                order = np.argsort(bound, axis=1, kind="stable")[:, first:last]
                least = np.array([np.nan if x is None else x for x in batch.column("least").to_pylist()])
                radius = np.sqrt(np.maximum((q * q).sum(axis=1) + longest - 2 * least, 0.0))
                reach = np.where(np.isnan(least), np.inf, radius * (1 + SLACK) + SLACK)
                ok = np.take_along_axis(bound, order, axis=1) <= reach[:, None]
                row, at = np.nonzero(ok)
                r = order[row, at]
                yield pa.record_batch({
                    "frame_idx": batch.column("frame_idx").take(pa.array(row)), "v": batch.column("v").take(pa.array(row)),
                    "least": pa.array(np.where(np.isnan(least), -np.inf, least)[row]),
                    "pivot": pa.array(pivot_of[r], pa.int32()), "ring": pa.array(ring_of[r], pa.int32()), "shards": pa.array(np.array(count)[r], pa.int32()),
                })

        return todo.mapInArrow(visit, "frame_idx long, v binary, least double, pivot int, ring int, shards int")

    def ask(todo: DataFrame, first: int, last: int | None) -> DataFrame:
        visits = settle(plan(todo, first, last))
        sizes = visits.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        blocked = visits.join(F.broadcast(sizes), ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("frame_idx"), F.col("blocks")).cast("int"))
        blocks = _packed(blocked, ["pivot", "ring", "shards", "block"], {"ids": "q_ids", "vectors": "q_vectors", "extra": "q_least"}, "least")
        pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).repartition("pivot", "ring", "shard", "block")
        return _score(pairs.join(store, ["pivot", "ring", "shard"]).select("ids", "vectors", "q_ids", "q_vectors", "q_least"), size, k)

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "frame_idx"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    found = None
    for first, last in ((0, 1), (1, RINGS), (RINGS, None)):
        if found is None:
            todo = asked.select("frame_idx", "v", F.lit(None).cast("double").alias("least"))
        else:
            kth = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("least"))
            todo = asked.join(kth, F.col("frame_idx") == F.col("query_id"), "left").select("frame_idx", "v", "least")
        more = ask(todo, first, last)
        found = settle(best(more if found is None else found.drop("rank").union(more)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "frame_idx", "score")
