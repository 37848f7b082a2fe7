"""Presets, thresholds, settings patches, rule edits and validation."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilmark.schemas import EVENT_SOURCES, PII_TYPES, STATUSES, STYLE_TYPES, TRACKING_METHODS

THRESHOLDS = "entity_confidence_overrides"
PRESET_FIELDS = [
    "ocr_sample_interval", "ocr_resolution_scale", "confidence_threshold", "detect_faces", "secure_mode",
    THRESHOLDS,
]


def upsert_presets(custom: DataFrame, changed: DataFrame) -> DataFrame:
    """Drop presets with a changed id and append the changed ones."""
    return custom.join(changed.select("preset_id"), "preset_id", "left_anti").unionByName(
        changed, allowMissingColumns=True
    )


def delete_presets(custom: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop presets by id; `deleted` ids that exist are reported by `found_presets`."""
    return custom.join(ids.select("preset_id"), "preset_id", "left_anti")


def found_presets(custom: DataFrame, ids: DataFrame) -> DataFrame:
    known = custom.select("preset_id").distinct().withColumn("found", F.lit(True))
    return ids.select("preset_id").distinct().join(known, "preset_id", "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def effective_presets(presets: DataFrame) -> DataFrame:
    """One preset per id; a built-in one hides a custom one."""
    first = Window.partitionBy("preset_id").orderBy(F.desc("builtin"), "preset_ord")
    return presets.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def patch_settings(base: DataFrame, patches: DataFrame, fields: list[str], key: str = "project_id") -> DataFrame:
    """Shallow merge: every given field replaces the stored one, a map as a whole.

    `given` of a patch lists the fields it sets, so a field can be set to null. Of several patches for a key the
    one with the highest `seq` counts, if patches have that column, else the greatest row.
    """
    turn = ["seq"] if "seq" in patches.columns else ["given", *fields]
    turn = [c for c in turn if not isinstance(patches.schema[c].dataType, T.MapType)]
    patch = patches.groupBy(key).agg(F.max_by(F.struct("given", *fields), F.struct(*turn)).alias("p")).select(
        key, "p.given", *[F.col(f"p.{f}").alias(f"_new_{f}") for f in fields]
    )
    given = lambda f: F.coalesce(F.array_contains("given", f), F.lit(False))
    return base.join(patch, key, "left").select(
        *[c for c in base.columns if c not in fields],
        *[F.when(given(f), F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
    )


def threshold_matrix(presets: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Threshold of every kind of data under every preset."""
    kinds = F.array(*[F.lit(t) for t in (types or PII_TYPES)])
    return presets.select(
        "preset_id", F.explode(kinds).alias("pii_type"), f"scan_settings.{THRESHOLDS}",
        "scan_settings.confidence_threshold",
    ).select(
        "preset_id", "pii_type",
        F.coalesce(F.try_element_at(THRESHOLDS, "pii_type"), "confidence_threshold").alias("threshold"),
    )


def preset_sweep(scored: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """How many scored findings each preset would keep.

    Findings are counted by (type, score) first, so only the distinct scores meet the presets.
    """
    counted = scored.groupBy(*keys, "pii_type", "score").agg(F.count("*").alias("n"))
    return counted.join(matrix, "pii_type").groupBy("preset_id", *keys, "pii_type").agg(
        F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("kept"),
        F.sum("n").alias("total"),
    )


def preset_totals(sweep: DataFrame) -> DataFrame:
    """Kept findings by preset and type with all subtotals."""
    return sweep.cube("preset_id", "pii_type").agg(
        F.sum("kept").alias("kept"), F.grouping_id().cast("int").alias("level")
    )


def apply_presets(settings: DataFrame, chosen: DataFrame, presets: DataFrame) -> DataFrame:
    """Copy the non-null fields of each project's chosen preset (project_id, preset_id) over its settings.

    Of several choices for a project the one with the highest `seq` counts, if `chosen` has it, else the greatest id.
    """
    turn = F.col("seq") if "seq" in chosen.columns else F.col("preset_id")
    chosen = chosen.groupBy("project_id").agg(F.max_by("preset_id", turn).alias("preset_id"))
    values = presets.select(
        "preset_id", *[F.col(f"scan_settings.{f}").alias(f"_p_{f}") for f in PRESET_FIELDS]
    )
    joined = settings.join(chosen, "project_id", "left").join(values, "preset_id", "left")
    hit = F.col("preset_id").isNotNull()
    return joined.select(
        *[c for c in settings.columns if c not in {*PRESET_FIELDS, "preset"}],
        F.when(hit, F.col("preset_id")).otherwise(F.col("preset")).alias("preset"),
        *[F.coalesce(f"_p_{f}", f).alias(f) for f in PRESET_FIELDS],
    )


def set_override(overrides: Column, pii_type: Column, value: Column) -> Column:
    """Put one threshold into the map."""
    return F.map_concat(F.map_filter(overrides, lambda k, _: k != pii_type), F.create_map(pii_type, value))


def reset_override(overrides: Column, pii_type: Column) -> Column:
    return F.map_filter(overrides, lambda k, _: k != pii_type)


def patch_rules(rules: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Change only the given fields of the first rule with the patched id."""
    first = Window.partitionBy("rule_id").orderBy("rule_ord")
    placed = rules.withColumn("_rn", F.row_number().over(first))
    patch = patches.select(
        "rule_id", F.lit(1).alias("_rn"), "given", *[F.col(f).alias(f"_new_{f}") for f in fields]
    )
    given = lambda f: F.coalesce(F.array_contains("given", f), F.lit(False))
    return placed.join(patch, ["rule_id", "_rn"], "left").select(
        *[
            F.when(given(c), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in rules.columns
        ]
    )


def unknown_rules(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Edits that name no rule."""
    return patches.join(rules.select("rule_id").distinct(), "rule_id", "left_anti")


def delete_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("rule_id"), "rule_id", "left_anti")


def add_rules(rules: DataFrame, added: DataFrame) -> DataFrame:
    """Append rules; ids are not checked for duplicates."""
    return rules.unionByName(added)


def active(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("enabled") & F.col("type").isin("regex", "context", "field_label"))


def migrate_encoder_flag(settings: DataFrame, legacy: str = "use_nvenc", current: str = "use_hw_encoder") -> DataFrame:
    """A legacy flag that is set overrides the current one."""
    return settings.withColumn(current, F.coalesce(legacy, current)).drop(legacy)


def event_problems(style: str = "style") -> dict[str, Column]:
    """Named violations of an event row."""
    look = F.col(style)
    return {
        "bad_confidence": ~F.col("confidence").between(0.0, 1.0),
        "bad_type": ~F.col("pii_type").isin(PII_TYPES),
        "bad_status": ~F.col("status").isin(STATUSES),
        "bad_style": ~look["type"].isin(STYLE_TYPES),
        "bad_strength": ~look["strength"].between(1, 100),
    }


def box_problems() -> dict[str, Column]:
    return {"bad_width": F.col("w") < 1, "bad_height": F.col("h") < 1}


def origin_problems() -> dict[str, Column]:
    return {
        "bad_source": ~F.col("source").isin(EVENT_SOURCES),
        "bad_method": ~F.col("tracking_method").isin(TRACKING_METHODS),
    }


def validate(df: DataFrame, problems: Mapping[str, Column]) -> DataFrame:
    """Flag each violation; a null counts as one. `valid` is true when there is none."""
    flags = {n: F.coalesce(c, F.lit(True)) for n, c in problems.items()}
    out = df.withColumns(flags)
    bad = F.lit(False)
    for name in flags:
        bad = bad | F.col(name)
    return out.withColumn("valid", ~bad)


def split_valid(flagged: DataFrame, problems: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the flags, and the quarantine with them."""
    return flagged.filter("valid").drop(*problems, "valid"), flagged.filter("NOT valid")
