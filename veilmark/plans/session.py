"""Session settings the operators rely on, and the shared scratch folder."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def with_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone, so naive timestamps turn into the same milliseconds everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder that the cluster names.

    Only in local mode, where everything runs on one machine, is a default set; a cluster must name a folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/veilmark-checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/veilmark/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where an iterative or multi-consumer step would otherwise recompute its input; the written
    files survive the loss of executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
