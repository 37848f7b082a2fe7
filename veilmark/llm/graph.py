"""Connected components of a link table, by alternating large-star and small-star steps on Spark."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.plans.session import settle


def components(links: DataFrame) -> DataFrame:
    """The smallest id reachable from each id that is not itself the smallest of its component.

    links: a, b (any orderable type; null and equal ends are ignored, repeated links count once). Returns node,
    component; ids that are missing here are their own component. Each step is written to the shared folder, so
    that a lost executor costs one step; the loop moves two numbers a step to the driver.
    """
    pairs = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    before = None
    while True:
        mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if mark == before or mark[0] == 0:
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = mark
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = settle(
            large.join(low, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("p"))
            .select("p.hi", "p.lo").where("hi <> lo").distinct()
        )
