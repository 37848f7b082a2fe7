"""Histogram distances."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms in [0, 1]; an empty histogram is at distance one from any."""
    zero = F.lit(0.0)

    def add(acc: Column, pair: Column) -> Column:
        return F.struct(
            (acc["shared"] + F.sqrt(pair["p"] * pair["q"])).alias("shared"),
            (acc["a"] + pair["p"]).alias("a"), (acc["b"] + pair["q"]).alias("b"),
        )

    def distance(acc: Column) -> Column:
        mass = F.sqrt(acc["a"] * acc["b"])
        return F.sqrt(F.greatest(zero, 1 - F.when(mass > 0, acc["shared"] / mass).otherwise(acc["shared"])))

    pairs = F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.aggregate(pairs, F.struct(zero.alias("shared"), zero.alias("a"), zero.alias("b")), add, distance)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda p, q: F.abs(p - q))) / F.size(a)


def blend(reference: Column, current: Column, alpha: float) -> Column:
    return F.zip_with(reference, current, lambda r, c: r * (1 - alpha) + c * alpha)
