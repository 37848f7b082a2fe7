"""Scan presets: the built-in ones and a custom file."""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.schemas import PRESET

# ---- fixed values: built-in presets ----------------------------------------------------------
# preset_id, interval, scale, threshold, phone, email, person, ssn, credit_card, account_id, face, faces on
BUILTIN = [
    ("customer_support_chat", 3, 1.0, 0.30, 0.30, 0.30, 0.40, 0.30, 0.30, 0.30, 0.35, True),
    ("forms_and_tables", 3, 1.5, 0.30, 0.30, 0.30, 0.45, 0.25, 0.25, 0.25, 0.40, False),
    ("quick_review", 10, 1.0, 0.50, 0.50, 0.50, 0.65, 0.40, 0.40, 0.50, 0.50, True),
    ("screen_recording_pii", 5, 1.0, 0.35, 0.35, 0.35, 0.50, 0.35, 0.35, 0.35, 0.40, True),
    ("thorough_scan", 2, 1.5, 0.25, 0.25, 0.25, 0.35, 0.20, 0.20, 0.25, 0.30, True),
]
OVERRIDE_TYPES = ["phone", "email", "person", "ssn", "credit_card", "account_id", "face"]


def builtin_presets(spark: SparkSession) -> DataFrame:
    rows = [
        (
            r[0], r[0].replace("_", " "), "", "builtin",
            (None, r[1], r[2], r[3], dict(zip(OVERRIDE_TYPES, r[4:11])), r[11], None, None), True, i,
        )
        for i, r in enumerate(BUILTIN)
    ]
    schema = T.StructType([
        *PRESET.fields, T.StructField("builtin", T.BooleanType()), T.StructField("preset_ord", T.IntegerType()),
    ])
    return spark.createDataFrame(rows, schema)


def _numbered(presets: DataFrame, builtin: bool, start: int) -> DataFrame:
    """Presets numbered by file and place in it; preset files are small, one task numbers them."""
    placed = presets.withColumns({"_file": F.input_file_name(), "_row": F.monotonically_increasing_id()})
    number = F.row_number().over(Window.orderBy("_file", "_row")) + (start - 1)
    return placed.withColumns({"builtin": F.lit(builtin), "preset_ord": number}).drop("_file", "_row")


def read_presets(spark: SparkSession, paths: Iterable[str] = (), custom_path: str | None = None) -> DataFrame:
    """Built-in presets sorted by file name, then custom ones; `paths` replaces the built-in set.

    A custom file that cannot be read counts as empty.
    """
    paths = list(paths)
    if paths:
        built = spark.read.schema(PRESET).option("multiLine", True).json(paths)
        built = _numbered(built.filter("preset_id IS NOT NULL"), True, 0)
    else:
        built = builtin_presets(spark)
    if custom_path is None:
        return built
    custom = spark.read.schema(PRESET).option("multiLine", True).option("mode", "PERMISSIVE").json(custom_path)
    custom = _numbered(custom.filter("preset_id IS NOT NULL"), False, len(BUILTIN))
    return built.unionByName(custom)

