"""Media files: inventory, fingerprints, probe documents and finished exports."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.functions.numeric import rational
from veilmark.schemas import MEDIA_EXTENSIONS, PROBE


def file_inventory(spark: SparkSession, folder: str, extensions: list[str] = MEDIA_EXTENSIONS) -> DataFrame:
    """Files with an allowed extension in any case; the contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return with_name(files.select("path", "length", "modificationTime"), F.col("path"), extensions)


def with_name(df: DataFrame, path: Column, extensions: list[str]) -> DataFrame:
    """Add base name and lower-case extension; keep allowed ones."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return df.withColumn("name", name).withColumn(
        "extension", F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    ).filter(F.col("extension").isin(extensions))


def file_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("file_hash"))


def changed_files(current: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """Files whose hash differs from the stored one; new files count as changed."""
    old = stored.select(key, F.col("file_hash").alias("_old"))
    return current.join(old, key, "left").withColumn(
        "changed", ~F.coalesce(F.col("file_hash") == F.col("_old"), F.lit(False))
    ).drop("_old")


def probe_metadata(probes: DataFrame, probe: str = "probe") -> DataFrame:
    """Metadata of the first video stream; documents without one are dropped (see `without_video`)."""
    parsed = probes.withColumn("_p", F.from_json(probe, PROBE))
    stream = F.get(F.filter("_p.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    return parsed.withColumn("_s", stream).filter("_s IS NOT NULL").select(
        *[c for c in probes.columns if c != probe],
        rational(F.coalesce("_s.r_frame_rate", F.lit("30/1"))).alias("fps"),
        (F.coalesce(F.col("_p.format.duration").try_cast("double"), F.lit(0.0)) * 1000).cast("long")
        .alias("duration_ms"),
        F.coalesce("_s.width", F.lit(0)).alias("width"), F.coalesce("_s.height", F.lit(0)).alias("height"),
        F.coalesce("_s.codec_name", F.lit("unknown")).alias("codec"),
        F.coalesce("_p.format.format_name", F.lit("unknown")).alias("format"),
    )


def without_video(probes: DataFrame, probe: str = "probe") -> DataFrame:
    """Documents that hold no video stream."""
    streams = F.coalesce(F.from_json(probe, PROBE)["streams"], F.array())
    return probes.filter(~F.coalesce(F.exists(streams, lambda s: s["codec_type"] == "video"), F.lit(False)))


def latest_exports(files: DataFrame, project: str = "project_id") -> DataFrame:
    """Newest finished output per project; unfinished `.tmp` files do not count."""
    newest = Window.partitionBy(project).orderBy(F.desc("modified"), F.desc("path"))
    return (
        files.filter(~F.col("path").endswith(".tmp")).withColumn("_rn", F.row_number().over(newest))
        .filter("_rn = 1").drop("_rn")
    )
