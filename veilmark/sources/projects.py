"""Project documents: one JSON file per project."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.operators.settings import migrate_encoder_flag
from veilmark.schemas import PROJECT


def read_projects(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """Projects and the quarantine of unreadable documents (path and raw text)."""
    schema = T.StructType([*PROJECT.fields, T.StructField("_corrupt", T.StringType())])
    raw = (
        spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(glob)
        .withColumn("path", F.input_file_name())
    )
    bad = F.col("_corrupt").isNotNull() | F.col("project_id").isNull()
    good = raw.filter(~bad).drop("_corrupt", "path").withColumn(
        "name", F.coalesce("name", F.lit("Untitled Project"))
    )
    settings = good.select("project_id", "output_settings.*")
    migrated = migrate_encoder_flag(settings)
    return (
        good.drop("output_settings").join(
            migrated.select("project_id", F.struct(*[c for c in migrated.columns if c != "project_id"])
                            .alias("output_settings")),
            "project_id",
        ),
        raw.filter(bad).select("path", "_corrupt"),
    )


def write_projects(projects: DataFrame, path: str) -> None:
    """Save projects as JSON lines with a fresh update time."""
    projects.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").json(path)


def list_projects(projects: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Summaries, most recently updated first.

    Events are counted where they are: in the project documents, or as rows of a table `events` with a project_id, which
    Spark counts before it moves them.
    """
    if events is None:
        counted = projects.withColumn("_n", F.size("events"))
    else:
        counted = projects.join(events.groupBy("project_id").agg(F.count("*").cast("int").alias("_n")), "project_id", "left")
    return counted.select(
        "project_id", "name", "created_at", "updated_at",
        F.col("video").isNotNull().alias("has_video"), F.greatest(F.coalesce("_n", F.lit(0)), F.lit(0)).alias("event_count"),
    ).orderBy(F.desc("updated_at"))


def project_events(projects: DataFrame) -> DataFrame:
    """Events of all projects, one row each, ranges and keyframes still nested."""
    return projects.select("project_id", F.explode("events").alias("e")).select("project_id", "e.*")


def event_keyframes(events: DataFrame) -> DataFrame:
    """One row per keyframe."""
    return events.select(
        "project_id", "event_id", "confidence", F.posexplode("keyframes").alias("kf_ord", "k")
    ).select("project_id", "event_id", "confidence", "kf_ord", "k.time_ms", "k.bbox.*", "k.polygon")


def event_ranges(events: DataFrame) -> DataFrame:
    """One row per time range."""
    return events.select(
        "project_id", "event_id", "status", F.posexplode("time_ranges").alias("range_ord", "r")
    ).select("project_id", "event_id", "status", "range_ord", "r.*")
