"""A blocked Bloom filter of 64-bit keys: all bits of a key lie in one 512-bit block.

The filter is built by a Spark aggregation, block by block, and has at most `max_blocks` blocks whatever the
number of keys, so that it may be broadcast: 64 bytes a block, 16 MB by default. Beyond that size it passes
more false hits; it never loses a true one. Callers join the hits exactly.
"""

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BLOCKS = 1 << 18
BITS_PER_KEY = 16
PROBES = 8


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def build(keys: DataFrame, key: str, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The filter as an array (blocks, 8) of 64-bit words; null keys are left out."""
    keys = keys.select(F.col(key).alias("key")).where("key IS NOT NULL")
    wanted = max(1, keys.count() * BITS_PER_KEY // 512)
    blocks = min(max_blocks, 1 << max(0, int(wanted - 1).bit_length()))
    again = F.xxhash64("key")
    flags = []
    for i in range(PROBES):
        nine = F.shiftrightunsigned(again, 7 * i).bitwiseAND(F.lit(511)).cast("int")
        flag = F.call_function("shiftleft", F.lit(1).cast("long"), nine.bitwiseAND(F.lit(63)))
        flags.append((F.shiftright(nine, 6), flag))
    none = F.lit(0).cast("long")
    word = [reduce(Column.bitwiseOR, [F.when(place == w, flag).otherwise(none) for place, flag in flags]) for w in range(8)]
    rows = (
        keys.select(_block(F.col("key"), blocks).alias("block"), *[c.alias(f"w{w}") for w, c in enumerate(word)])
        .groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(8)]).collect()
    )  # one row a block at most, bounded by max_blocks
    table = np.zeros((blocks, 8), np.int64)
    for row in rows:
        table[row[0]] = row[1:]
    return table.view(np.uint64)


def passes(table: np.ndarray, key: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Whether each key may be listed; `again` is xxhash64 of the key."""
    block = np.mod(key, len(table))
    mask = np.zeros((len(key), 8), np.uint64)
    again = again.view(np.uint64)
    for i in range(PROBES):
        nine = (again >> np.uint64(7 * i)) & np.uint64(511)
        place = (nine >> np.uint64(6)).astype(np.int64)
        mask[np.arange(len(key)), place] |= np.uint64(1) << (nine & np.uint64(63))
    return ((table[block] & mask) == mask).all(axis=1)


def keep_possible(df: DataFrame, key: str, table: np.ndarray) -> DataFrame:
    """The rows whose 64-bit key may be listed."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf(T.BooleanType())
    def possible(k: pd.Series, again: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, k.to_numpy(np.int64), again.to_numpy(np.int64)))

    return df.where(F.col(key).isNotNull()).where(possible(F.col(key), F.xxhash64(F.col(key))))
