"""Lists of exact terms as tables: any number of terms meets the texts in one pass and one join.

A term of n bytes is told by two hashes: that of its first 2^k bytes, where 2^k <= n < 2^(k + 1), and that of all of
it. Both go into a bit table of bounded size. A text is read once: the windows of each size 2^k that the bit table knows are
tried at the term lengths of their class, and what the table knows again is looked up in the term table by the hash of
the whole term and compared exactly. The plan and the bit table do not grow with the list; a long list only passes more
false hits to the join.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.functions.rolling import Rolling, scatter
from veilmark.operators.classify import FRAME
from veilmark.plans.session import settle
from veilmark.schemas import PII_TYPES

MAX_BITS = 27
BITS_PER_TERM = 64
PART_BITS = 18
BLOCK_BYTES = 1 << 20
HEAD_PROBES = 2
TERM_PROBES = 3


def _probes(hashes: np.ndarray, count: int, bits: int) -> list[np.ndarray]:
    return [(scatter(hashes + np.uint64(k + 1)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(count)]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashed(terms: DataFrame) -> DataFrame:
    """The terms with head (hash of their first 2^k bytes), whole (hash of all) and n_bytes."""
    schema = T.StructType([*terms.schema.fields, *[T.StructField(n, T.LongType()) for n in ("head", "whole", "n_bytes")]])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("low").cast(pa.binary()))
            size, sums = np.diff(offsets), Rolling(data)
            head = sums.windows(offsets[:-1], 1 << (np.frexp(size)[1] - 1).astype(np.int64))
            whole = sums.windows(offsets[:-1], size)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x.astype(np.int64)) for x in (head, whole, size)]], names=schema.names)

    return terms.mapInArrow(tell, schema)


def _bit_table(hashed: DataFrame, bits: int) -> np.ndarray:
    """The bit table as bytes; its parts are put together where their slots meet."""
    part_bits = min(PART_BITS, bits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, whole = (batch.column(c).to_numpy().astype(np.uint64) for c in ("head", "whole"))
            found = np.unique(np.concatenate(_probes(head, HEAD_PROBES, bits) + _probes(whole, TERM_PROBES, bits)))
            yield pa.record_batch({"part": pa.array(found >> part_bits), "slot": pa.array(found & ((1 << part_bits) - 1))})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            part, slot = batch.column("part").to_numpy(), batch.column("slot").to_numpy()
            for p in np.unique(part).tolist():
                tables.setdefault(p, np.zeros(1 << part_bits, bool))[slot[part == p]] = True
        for p, table in tables.items():
            yield pa.record_batch({"part": pa.array([p], pa.int64()), "body": pa.array([np.packbits(table, bitorder="little").tobytes()])})

    rows = hashed.select("head", "whole").mapInArrow(slots, "part long, slot long").repartition("part").mapInArrow(pack, "part long, body binary").collect()
    out = np.zeros(1 << max(0, bits - 3), np.uint8)  # 16 MB at most
    width = 1 << (part_bits - 3)
    for part, body in rows:
        out[part * width : (part + 1) * width] = np.frombuffer(body, np.uint8)
    return out


def _known(table: np.ndarray, hashes: np.ndarray, count: int, bits: int) -> np.ndarray:
    """Places of the hashes whose bits are all set."""
    at = np.arange(len(hashes))
    for k in range(count):
        slot = (scatter(hashes[at] + np.uint64(k + 1)) >> np.uint64(64 - bits)).astype(np.int64)
        at = at[(table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1]
    return at


def _possible(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lengths: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the terms that texts may hold, each once a text and block of BLOCK_BYTES."""
    reach, owners, found = max(lengths, default=1), [], []
    for at in range(0, len(data), BLOCK_BYTES):
        stop = min(len(data), at + BLOCK_BYTES)
        sums = Rolling(data[at : min(len(data), stop + reach)])
        place = np.arange(stop - at)
        owner = np.searchsorted(offsets, place + at, "right") - 1
        room = offsets[owner + 1] - at - place
        for size in sorted({1 << (n.bit_length() - 1) for n in lengths}):
            fits = place[room >= size]
            fits = fits[_known(table, sums.windows(fits, size), HEAD_PROBES, bits)]
            for n in lengths:
                if size <= n < 2 * size:
                    some = fits[room[fits] >= n]
                    whole = sums.windows(some, n)
                    good = _known(table, whole, TERM_PROBES, bits)
                    owners.append(owner[some[good]])
                    found.append(whole[good])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(owners).astype(np.uint64), np.concatenate(found)], axis=1), axis=0)
    return pairs[:, 0].astype(np.int64), pairs[:, 1]


def _candidates(texts: DataFrame, table: Broadcast, lengths: list[int], bits: int) -> DataFrame:
    """Rows of texts (row, low) once for each term hash that they may hold."""
    schema = T.StructType([texts.schema["row"], texts.schema["low"], T.StructField("whole", T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("low").cast(pa.binary()))
            owner, whole = _possible(data, offsets, table.value, lengths, bits)
            for a in range(0, len(owner), 4096):  # a long text may hold many terms
                some = pa.array(owner[a : a + 4096])
                yield pa.RecordBatch.from_arrays([batch.column("row").take(some), batch.column("low").take(some), pa.array(whole[a : a + 4096].astype(np.int64))], names=schema.names)

    return texts.mapInArrow(scan, schema)


def listed_terms(texts: DataFrame, terms: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """Every row of texts with every row of terms whose pattern stands anywhere in its text, ignoring case.

    Returns the columns of texts as one struct `row` and those of terms as one struct `term`, so that no names clash. A
    pattern that is null or empty is in no text, a null text holds no term. Repeated rows of either side are kept, and each
    pair of rows is returned once however often the term stands in the text.
    """
    spark = texts.sparkSession
    listed = terms.select(F.struct(*[F.col(f"`{c}`") for c in terms.columns]).alias("term"), F.lower(F.col(pattern)).alias("low")).where("low <> ''")
    left = texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("row"), F.lower(F.col(text)).alias("low"))
    hashed = settle(_hashed(listed))
    # the lengths in use, one row each, and the size of the list
    lengths = {r["n_bytes"]: r["count"] for r in hashed.groupBy("n_bytes").count().collect()}
    bits = min(MAX_BITS, max(10, (BITS_PER_TERM * sum(lengths.values())).bit_length()))
    table = spark.sparkContext.broadcast(_bit_table(hashed, bits))  # 2^MAX_BITS bits, 16 MB
    some = _candidates(left.where("low <> ''"), table, sorted(lengths), bits)
    wanted = hashed.select("term", F.col("low").alias("sought"), "whole")
    return some.join(wanted, "whole").where(F.instr("low", F.col("sought")) > 0).select("row", "term")


def deny_list_table(boxes: DataFrame, terms: DataFrame) -> DataFrame:
    """Boxes that hold a listed text anywhere, once per listed row, from a table of any size.

    terms: rules (rule_ord, rule_id, type, enabled, pattern, label, confidence, see schemas.RULE); only enabled rows of type
    denylist count. Gives the rows of `classify.deny_list`.
    """
    rules = terms.where("type = 'denylist' AND coalesce(enabled, true)").select(
        "rule_ord", "rule_id", F.when(F.col("label").isin(PII_TYPES), F.col("label")).otherwise("custom").alias("pii_type"), "confidence", "pattern"
    )
    found = listed_terms(boxes.select(*FRAME, "box_ord", "text", "bbox"), rules)
    return found.select("row.*", "term.rule_ord", "term.rule_id", "term.pii_type", "term.confidence")


def spared_by_table(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Candidates but those whose text is, as a whole, an enabled allowlist row of a table of any size, ignoring case."""
    allowed = terms.where("type = 'allowlist' AND coalesce(enabled, true) AND pattern IS NOT NULL").select(F.lower("pattern").alias("_low")).distinct()
    return candidates.join(allowed, F.lower(candidates["text"]) == F.col("_low"), "left_anti")
