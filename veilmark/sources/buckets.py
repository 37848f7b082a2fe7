"""Tables of many projects in a fixed number of buckets.

A project lies in one bucket, by the hash of its key, so that a million projects are as many files as there are buckets
and tasks, and reading one project reads one bucket. Rows are dealt over tasks by range within the buckets, so that a
project with a third of all rows is written by many tasks. The number of buckets is part of the path, hence a reader need
not know it. Spark's own commit makes the files appear at once or not at all.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def write_buckets(
    rows: DataFrame, path: str, key: str, order: Sequence[str], buckets: int = BUCKETS, form: str = "parquet"
) -> None:
    """Write rows by bucket of the key, within it in the given order; file names follow that order.

    Files of text are compressed. Columns named `buckets` or `bucket` give way. Rows with a null key are kept, in a bucket like any other.
    """
    placed = rows.withColumns({
        "buckets": F.lit(buckets), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"),
    })
    place = ["bucket", key, *order]
    writer = placed.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite")
    if form != "parquet":
        writer = writer.option("compression", "gzip")
    writer.partitionBy("buckets", "bucket").format(form).save(path)


def read_buckets(
    spark: SparkSession, path: str, schema: str, key: str, ids: Sequence[str] | None = None,
    form: str = "parquet",
) -> DataFrame:
    """All rows, or those of some keys, for which only their buckets are read; the schema is given as text."""
    table = spark.read.schema(f"{schema}, buckets int, bucket int").format(form).load(path)
    if ids is not None:
        wanted = F.lit(False)
        for one in ids:
            home = F.col("bucket") == F.pmod(F.xxhash64(F.lit(one)), F.col("buckets"))
            wanted = wanted | (home & (F.col(key) == one))
        table = table.filter(wanted)
    return table.drop("buckets", "bucket")
