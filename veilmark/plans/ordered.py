"""Ordered running values that survive a hot key.

A plain window over (key, order) puts all rows of one key into one task. Here the order axis is cut
into chunks: the window runs per (key, chunk), one summary row per chunk is carried along the key,
and the carry is joined back. The heavy shuffle is hashed by (key, chunk), so a key that holds a
third of the table is spread over as many tasks as it has chunks; only the summaries, smaller by the
number of rows per chunk, meet in one task per key.

The chunk expression must not decrease along the order.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "_chunk"


def chunk_by(order: str | Column, width: int) -> Column:
    """Equal steps along a numeric order column."""
    value = F.col(order) if isinstance(order, str) else order
    return F.floor(value / F.lit(width))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None = None,
    *,
    last: Mapping[str, Column] | None = None,
    prior: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns along `order` within `keys`.

    last   the latest non-null value at or before the row
    prior  the value on the previous row, null on the first
    total  the sum up to and including the row
    """
    last, prior, total = last or {}, prior or {}, total or {}
    ordering = [F.col(c) for c in order]

    if chunk is None:
        window = Window.partitionBy(*keys).orderBy(*ordering)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.last(e, ignorenulls=True).over(upto).alias(n) for n, e in last.items()],
            *[F.lag(e).over(window).alias(n) for n, e in prior.items()],
            *[F.sum(e).over(upto).alias(n) for n, e in total.items()],
        )

    tagged = df.withColumn(_CHUNK, chunk)
    window = Window.partitionBy(*keys, _CHUNK).orderBy(*ordering)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A previous value may itself be null, so it travels inside a struct.
    boxed = {n: F.struct(e.alias("v")) for n, e in prior.items()}
    local = tagged.select(
        "*",
        *[F.last(e, ignorenulls=True).over(upto).alias(f"_in_{n}") for n, e in last.items()],
        *[F.lag(e).over(window).alias(f"_in_{n}") for n, e in boxed.items()],
        *[F.sum(e).over(upto).alias(f"_in_{n}") for n, e in total.items()],
    )

    place = F.struct(*ordering)
    summary = tagged.groupBy(*keys, _CHUNK).agg(
        *[F.max_by(e, F.when(e.isNotNull(), place)).alias(f"_end_{n}") for n, e in last.items()],
        *[F.max_by(e, place).alias(f"_end_{n}") for n, e in boxed.items()],
        *[F.sum(e).alias(f"_end_{n}") for n, e in total.items()],
    )
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, _CHUNK,
        *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_pre_{n}") for n in last],
        *[F.lag(f"_end_{n}").over(along).alias(f"_pre_{n}") for n in boxed],
        *[F.sum(f"_end_{n}").over(before).alias(f"_pre_{n}") for n in total],
    )

    joined = local.join(carried, [*keys, _CHUNK], "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_in_{n}", f"_pre_{n}").alias(n) for n in last],
        *[F.coalesce(f"_in_{n}", f"_pre_{n}")["v"].alias(n) for n in boxed],
        *[
            F.when(F.col(f"_pre_{n}").isNull(), F.col(f"_in_{n}"))
            .when(F.col(f"_in_{n}").isNull(), F.col(f"_pre_{n}"))
            .otherwise(F.col(f"_in_{n}") + F.col(f"_pre_{n}")).alias(n)
            for n in total
        ],
    )


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, chunk: Column | None = None
) -> DataFrame:
    """Row number from 1 along the order within the keys."""
    return running(df, keys, order, chunk, total={name: F.lit(1).cast("long")})


def latest_before(
    left: DataFrame,
    marks: DataFrame,
    keys: Sequence[str],
    at: str,
    mark: str,
    name: str,
    chunk_width: int,
) -> DataFrame:
    """As-of join: for each left row, the greatest mark strictly before its time, or null.

    Both sides are stacked and swept once, so neither a range join nor a per-key array is needed.
    """
    stacked = (
        left.withColumn("_at", F.col(at).cast("long")).withColumn("_kind", F.lit(0))
        .unionByName(
            marks.select(*keys, F.col(mark).cast("long").alias("_at"), F.lit(1).alias("_kind")).distinct(),
            allowMissingColumns=True,
        )
    )
    swept = running(
        stacked, keys, ["_at", "_kind"], chunk_by("_at", chunk_width),
        last={name: F.when(F.col("_kind") == 1, F.col("_at"))},
    )
    return swept.filter(F.col("_kind") == 0).drop("_at", "_kind")
