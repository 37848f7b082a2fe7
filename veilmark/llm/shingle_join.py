"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.llm import bloom, graph
from veilmark.llm import words as W
from veilmark.plans.session import settle

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH_BITS = 18
SKETCH_PARTS = 64
SEEN_SETS = 1 << 19
PIVOTS = 32


def _set_id(one: np.ndarray) -> bytes:
    return hashlib.blake2b(one.tobytes(), digest_size=16).digest()


def _mark(one: np.ndarray) -> int:
    """A short hash that tells the few sets of one frame apart."""
    return int((one.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33))


def _scan(frames: DataFrame, size: int) -> DataFrame:
    """One pass over the texts: a row per frame (text_hash, n_shingles, set_id, mark), and per task a count sketch of shingles.

    The sketch has two rows of 2^SKETCH_BITS counters, in SKETCH_PARTS parts, whatever the number of texts.
    """
    width = 1 << SKETCH_BITS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, width), np.int64)
        for whole in batches:
            for batch in W.slices(whole, "composite"):
                sets = W.shingle_sets(batch.column("composite"), size)
                every = np.concatenate(sets)
                for row, slot in enumerate(_slots(every)):
                    sketch[row] += np.bincount(slot, minlength=width)
                n = len(sets)
                yield pa.record_batch({
                    "frame_idx": batch.column("frame_idx"), "text_hash": batch.column("text_hash"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_id": pa.array([_set_id(s) if len(s) else None for s in sets], pa.binary()),
                    "mark": pa.array([_mark(s) if len(s) else None for s in sets], pa.int32()),
                    "part": pa.array([None] * n, pa.int32()), "counts": pa.array([None] * n, pa.binary()),
                })
        if sketch.any():
            parts = [p.astype(np.min_scalar_type(int(p.max()))) for p in np.split(sketch.ravel(), SKETCH_PARTS)]
            yield pa.record_batch({
                "frame_idx": pa.array([None] * SKETCH_PARTS, pa.int64()), "text_hash": pa.array([None] * SKETCH_PARTS, pa.int64()), "n_shingles": pa.array([None] * SKETCH_PARTS, pa.int64()),
                "set_id": pa.array([None] * SKETCH_PARTS, pa.binary()), "mark": pa.array([None] * SKETCH_PARTS, pa.int32()), "part": pa.array(range(SKETCH_PARTS), pa.int32()),
                "counts": pa.array([p.tobytes() for p in parts], pa.binary()),
            })

    return frames.mapInArrow(scan, "frame_idx long, text_hash long, n_shingles long, set_id binary, mark int, part int, counts binary")


def _slots(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (shingles & mask).astype(np.int64), ((shingles >> np.uint64(32)) & mask).astype(np.int64)


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The counters of all texts: each part is summed where its rows meet, then SKETCH_PARTS rows are collected."""
    length = (2 << SKETCH_BITS) // SKETCH_PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                if part not in sums:
                    sums[part] = np.zeros(length, np.int64)
                sums[part] += np.frombuffer(body, np.dtype(f"u{len(body) // length}"))
        if sums:
            yield pa.record_batch({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    rows = (
        scanned.where("part IS NOT NULL").select("part", "counts").repartition(SKETCH_PARTS // 4, "part")
        .mapInArrow(add, "part int, counts binary").collect()
    )
    out = np.zeros(2 << SKETCH_BITS, np.int64)
    for part, body in rows:
        out[part * length : (part + 1) * length] = np.frombuffer(body, np.int64)
    return out.reshape(2, -1)


def _prefixes(frames: DataFrame, size: int, percent: int, sketch: Broadcast) -> DataFrame:
    """The rarest shingles of each set, as many as any partner must share one of: shingle, frame_idx, mark, n, pos.

    Rarity is the sketch count, ties go by hash, so all sets have one order. Copies within a task give one set.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        for whole in batches:
            for batch in W.slices(whole, "composite"):
                ids = batch.column("frame_idx").to_pylist()
                key, owner, label, length, place = [], [], [], [], []
                for ident, one in zip(ids, W.shingle_sets(batch.column("composite"), size)):
                    n = len(one)
                    if not n or ident is None:
                        continue
                    name = _set_id(one)
                    if name in seen:
                        continue
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(name)
                    first, second = _slots(one)
                    width = n - -(-percent * n // 100) + 1
                    rank = np.lexsort((one, np.minimum(counts[0][first], counts[1][second])))[:width]
                    key.append(one[rank])
                    owner.append(np.full(width, ident, np.int64))
                    label.append(np.full(width, _mark(one), np.int32))
                    length.append(np.full(width, n, np.int32))
                    place.append(np.arange(width, dtype=np.int32))
                if key:
                    yield pa.record_batch({
                        "shingle": pa.array(np.concatenate(key).view(np.int64)), "frame_idx": pa.array(np.concatenate(owner)),
                        "mark": pa.array(np.concatenate(label)),
                        "n": pa.array(np.concatenate(length)), "pos": pa.array(np.concatenate(place)),
                    })

    return frames.mapInArrow(cut, "shingle long, frame_idx long, mark int, n int, pos int")


def _bound(percent: int, first: bool = False) -> str:
    """Length and positional filter on sides a and b that share a shingle at a.pos and b.pos.

    first: as if no shingle before these places were shared. That is so where an alike pair first meets, hence
    every alike pair passes there, while most pairs that meet late in their prefixes pass nowhere.
    """
    before = "0" if first else "least(a.pos, b.pos)"
    return (
        f"100L * least(a.n, b.n) >= {percent}L * greatest(a.n, b.n) AND {100 + percent}L * "
        f"({before} + least(a.n - a.pos, b.n - b.pos)) >= {percent}L * (a.n + b.n)"
    )


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the similarity, each looked at once.

    texts: node, composite, one row a node. The text of a travels to b; rows of one b are neighbours after the join, so its set is
    made once. The suffix filter compares how many shingles fall between PIVOTS pivots on both sides and skips the full look.
    """
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("composite").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("composite").alias("text_b")), "b")
    pivots = np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64((1 << 64) // (PIVOTS + 1))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, other, spread = None, np.zeros(0, np.uint64), None
        for whole in batches:
            for batch in W.slices(whole, "text_a", 1 << 20):
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                good = []
                for i, one in enumerate(W.shingle_sets(batch.column("text_a"), size)):
                    if b[i] != held:
                        held, other = b[i], W.shingle_sets(batch.column("text_b").slice(i, 1), size)[0]
                        spread = np.diff(np.searchsorted(other, pivots), prepend=0, append=len(other))
                    need = -(-percent * (len(one) + len(other)) // (100 + percent))
                    here = np.diff(np.searchsorted(one, pivots), prepend=0, append=len(one))
                    if np.minimum(here, spread).sum() < need:
                        continue
                    if len(np.intersect1d(one, other, assume_unique=True)) >= need:
                        good.append(i)
                yield pa.record_batch({"a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())})

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def similar_frames(frames: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of frames whose joined texts are alike.

    frames: frame_idx (long), composite. Words are runs without blank or U+0009 to U+000D, A-Z as a-z. A frame's
    set holds its distinct shingles of `size` words; fewer words count as one shingle, no words as none. Two frames
    link if 100 * shared >= percent * united. Returns a row per row of frames: frame_idx, n_shingles (of that row), component_id
    (the smallest frame_idx reachable by links, itself included). Frames with an empty set or a null text link with
    nothing; rows without frame_idx get component null. Rows that repeat a frame_idx are one frame with several texts: it
    links by any of them, and they get one component. Shingles are compared by 64-bit hashes, sets by 128-bit ones. Other columns are ignored; frame_idx must be over -2^62.

    1. One pass counts shingles in a bounded sketch and names each set; copies share a set, and sets are what is joined.
    2. The rare-first prefixes meet by shingle; shingles that only one set has in its prefix drop out.
    3. Each set is compared with that of the smallest frame at each shared shingle, which links a family of near copies by a
       number of pairs that grows with the family, not with its square.
    4. What step 3 left apart is joined pair by pair at the shingles where more than one component meets.
    """
    base = frames.select(F.col("frame_idx").cast("long").alias("frame_idx"), "composite", F.xxhash64("composite").alias("text_hash"))
    scanned = settle(_scan(base, size))
    meta = scanned.where("part IS NULL").select("frame_idx", "text_hash", "n_shingles", "set_id", "mark")
    known = meta.where("set_id IS NOT NULL AND frame_idx IS NOT NULL")
    nodes = _nodes(known)
    moved = nodes.where("node <> frame_idx OR last > frame_idx").select("set_id", "node")
    copies = settle(known.join(moved, "set_id").where("frame_idx <> node").select("frame_idx", "mark", "node").distinct())
    sketch = base.sparkSession.sparkContext.broadcast(_sketch(scanned))  # 2^SKETCH_BITS counters, two rows: 4 MB
    met = F.count("*").over(Window.partitionBy("shingle"))
    shared = settle(_prefixes(base, size, percent, sketch).withColumn("met", met).where("met > 1").drop("met"))
    shared = settle(
        shared.join(copies, ["frame_idx", "mark"], "left").select("shingle", F.coalesce("node", "frame_idx").alias("node"), "n", "pos").distinct()
    )
    lead = shared.groupBy("shingle").agg(F.min(F.struct("node", "n", "pos")).alias("b"))
    near = settle(
        shared.select("shingle", F.struct("node", "n", "pos").alias("a")).join(lead, "shingle")
        .where("a.node <> b.node").where(_bound(percent)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    )
    several = shared.groupBy("shingle").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    involved = settle(shared.join(several, "shingle").select("node").distinct().join(nodes, "node").select("node", "frame_idx", "text_hash"))
    texts = settle(
        bloom.keep_possible(base, "frame_idx", bloom.build(involved, "frame_idx")).join(involved, ["frame_idx", "text_hash"])
        .select("node", "composite").dropDuplicates(["node"])
    )
    first = settle(_verify(near, texts, size, percent))
    group = graph.components(first)
    placed = settle(
        shared.join(group, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("component", "node").alias("c"))
    )
    apart = placed.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("shingle")
    rest = placed.join(apart, "shingle", "left_semi")
    crossing = (
        rest.alias("a").join(rest.alias("b"), "shingle").where("a.c < b.c").where(_bound(percent, first=True))
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    )
    crossing = settle(crossing.join(near.union(near.select("b", "a")), ["a", "b"], "left_anti"))
    second = settle(_verify(crossing, texts, size, percent))
    return meta.join(_frame_components(known, nodes, group, second), "frame_idx", "left").select(
        "frame_idx", "n_shingles", F.coalesce("component_id", "frame_idx").alias("component_id")
    )


def _nodes(known: DataFrame) -> DataFrame:
    """A row a set: set_id, node (a number of its own), frame_idx and text_hash of one text of it, last (its largest frame_idx).

    The node is the smallest frame_idx with the set. Of several sets with the same smallest frame all but one get
    numbers below all frames.
    """
    first = F.min(F.struct("frame_idx", "text_hash"))
    classes = settle(known.groupBy("set_id").agg(first.alias("first"), F.max("frame_idx").alias("last")).select("set_id", "first.*", "last"))
    crowded = classes.groupBy("frame_idx").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x < y").select("frame_idx", "x")
    others = settle(classes.join(crowded, "frame_idx").where("set_id <> x").select("set_id", (F.monotonically_increasing_id() + F.lit(-(1 << 63))).alias("low")))
    return settle(classes.join(others, "set_id", "left").select("set_id", F.coalesce("low", "frame_idx").alias("node"), "frame_idx", "text_hash", "last"))


def _frame_components(known: DataFrame, nodes: DataFrame, group: DataFrame, links: DataFrame) -> DataFrame:
    """frame_idx, component_id of the frames whose sets have copies, links or company, out of the components of nodes.

    The sets of a frame with several texts are united first.
    """
    crowded = known.groupBy("frame_idx").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x < y").select("frame_idx")
    of_crowd = settle(known.join(crowded, "frame_idx").select("frame_idx", "set_id").distinct().join(nodes.select("set_id", "node"), "set_id"))
    least = of_crowd.groupBy("frame_idx").agg(F.min("node").alias("b"))
    united = of_crowd.join(least, "frame_idx").select(F.col("node").alias("a"), "b")
    of_node = settle(graph.components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links).union(united)))
    member = of_node.union(of_node.select("component", "component").distinct())
    placed = nodes.join(member, "node", "left").where("component IS NOT NULL OR last > frame_idx")
    placed = settle(placed.select("set_id", "frame_idx", F.coalesce("component", "node").alias("component")))
    smallest = placed.groupBy("component").agg(F.min("frame_idx").alias("component_id"))
    ends = settle(placed.select("set_id", "component").join(smallest, "component").select("set_id", "component_id"))
    return known.join(ends, "set_id").groupBy("frame_idx").agg(F.min("component_id").alias("component_id"))
