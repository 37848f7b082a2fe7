"""Ordered windows over chunks, hot keys, and the shared folder."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilmark.plans.ordered import chunk_by, latest_before, ranked, running
from veilmark.plans.session import settle, shared_folder


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        # One key holds most rows, and values have holes.
        key = "hot" if i % 3 else rng.choice("abcdef")
        rows.append((key, rng.randrange(0, 5000), i, rng.choice([None, rng.randrange(100)])))
    return spark.createDataFrame(rows, "k string, t long, i long, v int")


@pytest.mark.parametrize("width", [1, 37, 1000, 10_000])
def test_running_equals_plain_window(log, width):
    order = Window.partitionBy("k").orderBy("t", "i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = log.select(
        "*", F.last("v", True).over(upto).alias("l"), F.lag("v").over(order).alias("p"),
        F.sum("v").over(upto).alias("s"), F.row_number().over(order).cast("long").alias("n"),
    )
    chunked = ranked(
        running(log, ["k"], ["t", "i"], chunk_by("t", width), last={"l": F.col("v")}, prior={"p": F.col("v")},
                total={"s": F.col("v")}),
        ["k"], ["t", "i"], "n", chunk_by("t", width),
    )
    assert sorted(map(str, chunked.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_latest_before_is_strict(spark):
    left = spark.createDataFrame([("a", 5), ("a", 6), ("b", 9)], "k string, t long")
    marks = spark.createDataFrame([("a", 5), ("a", 2), ("a", 8)], "k string, m long")
    found = {(r.k, r.t): r.c for r in latest_before(left, marks, ["k"], "t", "m", "c", 3).collect()}
    assert found == {("a", 5): 2, ("a", 6): 5, ("b", 9): None}


def test_heavy_shuffle_is_by_key_and_chunk(log):
    plan = running(log, ["k"], ["t"], chunk_by("t", 100), last={"l": F.col("v")})._jdf.queryExecution().toString()
    assert "hashpartitioning(k" in plan and "_chunk" in plan.split("hashpartitioning(k")[1].split(")")[0]


def test_shared_folder_comes_from_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    folder = shared_folder(spark)
    assert before is None or folder.startswith(before.rstrip("/"))
    assert folder != shared_folder(spark)


def test_settle_round_trip(spark):
    df = spark.range(5).withColumn("s", F.struct(F.col("id").alias("a")))
    assert settle(df).orderBy("id").collect() == df.orderBy("id").collect()
