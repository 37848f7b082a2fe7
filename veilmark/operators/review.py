"""Review state: decisions, styles, views of the findings, and the action log.

Events are rows keyed by (project_id, event_id).
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilmark.functions.text import fold_text
from veilmark.plans.ordered import ranked
from veilmark.schemas import STATUSES, STYLE_TYPES, UNDO_DEPTH

KEY = ["project_id", "event_id"]


def _check(status: str) -> None:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")


def set_statuses(events: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply one decision per listed event (project_id, event_id, new_status); unknown ids do nothing.

    Of several decisions on an event the one with the highest `seq` counts, if updates have that column, else the
    last in the order of STATUSES. Updates with an unknown status are left out; `bad_statuses` lists them.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("new_status"))
    turn = F.struct("seq", order) if "seq" in updates.columns else order
    valid = updates.filter(F.col("new_status").isin(STATUSES)).groupBy(*KEY).agg(
        F.max_by("new_status", turn).alias("new_status")
    )
    return events.join(valid, KEY, "left").withColumns({
        "status": F.coalesce("new_status", "status"), "updated": F.col("new_status").isNotNull(),
    }).drop("new_status")


def bad_statuses(updates: DataFrame) -> DataFrame:
    return updates.filter(~F.coalesce(F.col("new_status").isin(STATUSES), F.lit(False)))


def bulk_set_status(events: DataFrame, status: str, ids: DataFrame | None = None) -> DataFrame:
    """One status for the listed events, or for all when no list is given."""
    _check(status)
    if ids is None:
        return events.withColumns({"status": F.lit(status), "updated": F.lit(True)})
    return set_statuses(events, ids.select(*KEY, F.lit(status).alias("new_status")))


def bulk_set_style(events: DataFrame, style: dict, ids: DataFrame | None = None) -> DataFrame:
    """One style for the listed events, or for all."""
    if style["type"] not in STYLE_TYPES or not 1 <= style["strength"] <= 100:
        raise ValueError("invalid style")
    look = F.struct(
        F.lit(style["type"]).alias("type"), F.lit(style["strength"]).alias("strength"),
        F.lit(style["color"]).alias("color"),
    )
    if ids is None:
        return events.withColumns({"style": look, "updated": F.lit(True)})
    listed = ids.select(*KEY).distinct().withColumn("_l", F.lit(True))
    return events.join(listed, KEY, "left").withColumns({
        "style": F.when(F.col("_l"), look).otherwise(F.col("style")),
        "updated": F.coalesce("_l", F.lit(False)),
    }).drop("_l")


def add_delete(events: DataFrame, added: DataFrame, deleted: DataFrame) -> DataFrame:
    """Append events and remove others by id."""
    return events.unionByName(added).join(deleted.select(*KEY).distinct(), KEY, "left_anti")


# ---- views -----------------------------------------------------------------------------------

def filter_findings(events: DataFrame, pii_type: str = "all", status: str = "all") -> DataFrame:
    if pii_type != "all":
        events = events.filter(F.col("pii_type") == pii_type)
    return events if status == "all" else events.filter(F.col("status") == status)


def view_order(sort_by: str = "time") -> list[Column]:
    """Sort keys of the findings list; the event id settles ties."""
    head = F.desc("confidence") if sort_by == "confidence" else F.coalesce(F.col("start_ms"), F.lit(0)).asc()
    return [head, F.col("event_id").asc()]


def sort_findings(events: DataFrame, sort_by: str = "time") -> DataFrame:
    return events.orderBy("project_id", *view_order(sort_by))


def group_key(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "group_key", F.concat(F.col("pii_type"), F.lit("::"), fold_text(F.col("extracted_text")))
    )


def group_findings(events: DataFrame) -> DataFrame:
    """One row per group of equal texts: first appearance, representative, size and status.

    Members are not gathered; they keep their `group_key` and can be looked up by it.
    """
    place = F.struct(F.coalesce(F.col("start_ms"), F.lit(0)).alias("start_ms"), F.col("event_id"))
    accepted = F.count_if(F.col("status") == "accepted")
    one = F.min("status") == F.max("status")
    return group_key(events).groupBy("project_id", "group_key").agg(
        F.min(place).alias("first"), F.count("*").alias("group_size"), accepted.alias("n_accepted"),
        F.when(one, F.min("status")).otherwise(F.lit("mixed")).alias("group_status"),
    ).select(
        "project_id", "group_key", F.col("first.event_id").alias("representative"),
        F.col("first.start_ms").alias("first_start_ms"), "group_size", "group_status",
        F.when(
            F.col("group_status") == "mixed",
            F.concat(F.col("n_accepted").cast("string"), F.lit("/"), F.col("group_size").cast("string"), F.lit(" accepted")),
        ).otherwise(F.col("group_status")).alias("status_label"),
    )


def status_counts(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in STATUSES
    ])


def accept_visible(events: DataFrame, pii_type: str = "all", status: str = "all") -> DataFrame:
    """Accept the pending events among the visible ones."""
    seen = _visible(pii_type, status)
    return events.withColumn(
        "status", F.when(seen & (F.col("status") == "pending"), F.lit("accepted")).otherwise(F.col("status"))
    )


def reject_visible(events: DataFrame, pii_type: str = "all", status: str = "all") -> DataFrame:
    """Reject every visible event."""
    return events.withColumn(
        "status", F.when(_visible(pii_type, status), F.lit("rejected")).otherwise(F.col("status"))
    )


def _visible(pii_type: str, status: str) -> Column:
    seen = F.lit(True) if pii_type == "all" else F.col("pii_type") == pii_type
    return seen if status == "all" else seen & (F.col("status") == status)


def style_group(events: DataFrame) -> DataFrame:
    """Name the style group of each event: its exact text, or itself when it has none."""
    has_text = F.coalesce(F.col("extracted_text"), F.lit("")) != ""
    return events.withColumn(
        "style_group", F.when(has_text, F.concat(F.lit("t:"), F.col("extracted_text")))
        .otherwise(F.concat(F.lit("e:"), F.col("event_id").cast("string")))
    )


def restyle_groups(events: DataFrame, chosen: DataFrame) -> DataFrame:
    """Give the style of each chosen event (project_id, event_id, new_style) to its whole group."""
    grouped = style_group(events)
    wanted = grouped.join(chosen, KEY).groupBy("project_id", "style_group").agg(
        F.max_by("new_style", "event_id").alias("new_style")
    )
    return grouped.join(wanted, ["project_id", "style_group"], "left").withColumn(
        "style", F.coalesce("new_style", "style")
    ).drop("new_style", "style_group")


def same_style(style: Column, other: dict) -> Column:
    return (
        (style["type"] == other["type"]) & (style["strength"] == other["strength"])
        & (style["color"] == other["color"])
    )


def restyle_uncustomised(events: DataFrame, old: dict, new: dict) -> DataFrame:
    """Events that still carry the old default get the new one."""
    look = F.struct(
        F.lit(new["type"]).alias("type"), F.lit(new["strength"]).alias("strength"), F.lit(new["color"]).alias("color")
    )
    return events.withColumn("style", F.when(same_style(F.col("style"), old), look).otherwise(F.col("style")))


def style_impact(events: DataFrame, default: dict, keys: list[str]) -> DataFrame:
    """How many events follow the default style, and how many do not."""
    follows = same_style(F.col("style"), default)
    return events.groupBy(*keys).agg(
        F.count_if(follows).alias("affected"), F.count_if(~follows).alias("customised"),
        F.count("*").alias("total"),
    )


def auto_accept(events: DataFrame) -> DataFrame:
    return events.withColumn("status", F.lit("accepted"))


# ---- fixed values: smallest width of a timeline segment, in percent --------------------------
MIN_SEGMENT_PCT = 0.3


def timeline_segments(ranges: DataFrame, duration_ms: Column) -> DataFrame:
    start = F.col("start_ms") / duration_ms * 100
    end = F.col("end_ms") / duration_ms * 100
    return ranges.withColumn("start_pct", start).withColumn(
        "width_pct", F.greatest(F.lit(MIN_SEGMENT_PCT), end - start)
    )


def split_event(events: DataFrame, at_ms: Column) -> DataFrame:
    """Split events that span a time into a part up to it and a part after it; others stay whole."""
    inside = (at_ms > F.col("start_ms")) & (at_ms < F.col("end_ms"))
    part = F.explode(F.when(inside, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    return events.withColumn("part", part).withColumns({
        "start_ms": F.when(F.col("part") == 2, at_ms + 1).otherwise(F.col("start_ms")),
        "end_ms": F.when(F.col("part") == 1, at_ms).otherwise(F.col("end_ms")),
    })


def split_keyframes(keyframes: DataFrame, parts: DataFrame) -> DataFrame:
    """Give each keyframe to the part of its event whose range holds it."""
    return keyframes.join(parts.select(*KEY, "part", "start_ms", "end_ms"), KEY).filter(
        F.col("time_ms").between(F.col("start_ms"), F.col("end_ms"))
    ).drop("start_ms", "end_ms")


# ---- action log ------------------------------------------------------------------------------
#
# Log rows: project_id, event_id, seq, kind ('status', 'style', 'add', 'delete', ...), after, before.

def replay_log(log: DataFrame) -> DataFrame:
    """State after all actions: the newest value per event and field, and whether the event exists."""
    lives = F.col("kind").isin("add", "delete")
    return log.groupBy(*KEY).agg(
        F.max_by("after", F.when(F.col("kind") == "status", F.col("seq"))).alias("status"),
        F.max_by("after", F.when(F.col("kind") == "style", F.col("seq"))).alias("style"),
        F.coalesce(F.max_by("kind", F.when(lives, F.col("seq"))) != "delete", F.lit(True)).alias("alive"),
        F.count("*").alias("n_actions"),
    )


def undo_stack(log: DataFrame, depth: int = UNDO_DEPTH) -> DataFrame:
    """Rank the newest actions of each project from 1; only `depth` of them can be undone.

    Rank filtering with a limit keeps `depth` rows per task before the shuffle (window group limit).
    """
    newest = Window.partitionBy("project_id").orderBy(F.desc("seq"))
    return log.withColumn("undo_rank", F.row_number().over(newest)).filter(F.col("undo_rank") <= depth)


def undo(log: DataFrame, steps: int, depth: int = UNDO_DEPTH) -> DataFrame:
    """The log without the last `steps` actions of each project, at most `depth` of them."""
    undone = undo_stack(log, min(steps, depth)).select("project_id", "seq")
    return log.join(undone, ["project_id", "seq"], "left_anti")


def redoable(log: DataFrame, undone: DataFrame) -> DataFrame:
    """Undone actions that can come back: none once the project got a newer action."""
    newest = log.groupBy("project_id").agg(F.max("seq").alias("_newest"))
    return undone.join(newest, "project_id", "left").filter(
        F.col("_newest").isNull() | (F.col("seq") > F.col("_newest"))
    ).drop("_newest")


def ranked_log(log: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Position of each action in its project."""
    return ranked(log, ["project_id"], ["seq"], "position", chunk)
