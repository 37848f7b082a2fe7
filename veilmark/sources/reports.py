"""Audit reports as ordered lines.

A report is a header, one line per accepted event and a footer. Lines carry their place, so a project
with very many events is written by many tasks and never gathered into one value.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.text import escape_html, percent
from veilmark.sources.buckets import BUCKETS, read_buckets, write_buckets

# Sections of a report in order.
HEADER, BODY, FOOTER = 0, 1, 2
_LINES = "project_id string, section int, event_id bigint, line string"


def event_json(audit: DataFrame) -> Column:
    """One accepted event as JSON."""
    fields = F.struct(
        F.col("event_id").cast("string").alias("event_id"), "pii_type", "confidence", "extracted_text",
        F.array(F.struct("start_ms", "end_ms")).alias("time_ranges"), "tracking_method", "redaction_style",
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def summary_json(generated_at: Column) -> Column:
    """The report head as JSON, without its closing brace."""
    head = F.to_json(F.struct(
        generated_at.alias("report_generated_at"), F.col("project_id"), F.col("project_name"),
        F.struct(F.col("path"), F.col("duration_ms")).alias("video"),
        F.struct("total_events", "accepted", "rejected", "pending").alias("summary"),
    ), {"ignoreNullFields": "false"})
    return head


def json_report(summary: DataFrame, audit: DataFrame, generated_at: Column) -> DataFrame:
    """Report lines (project_id, section, event_id, line); in order they form one JSON document."""
    head = summary.withColumn("_h", summary_json(generated_at)).select(
        "project_id", F.lit(HEADER).alias("section"), F.lit(None).cast("bigint").alias("event_id"),
        F.concat(F.expr("substring(_h, 1, length(_h) - 1)"), F.lit(',"redacted_events":[')).alias("line"),
    )
    first = audit.groupBy("project_id").agg(F.min("event_id").alias("_first"))
    body = audit.join(first, "project_id").select(
        "project_id", F.lit(BODY).alias("section"), "event_id",
        F.concat(F.when(F.col("event_id") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), event_json(audit))
        .alias("line"),
    )
    foot = summary.select(
        "project_id", F.lit(FOOTER).alias("section"), F.lit(None).cast("bigint").alias("event_id"),
        F.lit("]}").alias("line"),
    )
    return head.unionByName(body).unionByName(foot)


def html_row() -> Column:
    """One accepted event as a table row; every value is escaped."""
    ranges = F.concat(
        F.col("start_ms").cast("string"), F.lit("ms–"), F.col("end_ms").cast("string"), F.lit("ms")
    )
    text = F.when(F.coalesce(F.col("extracted_text"), F.lit("")) != "", F.col("extracted_text")).otherwise(
        F.lit("[redacted]")
    )
    cells = [escape_html(F.col("pii_type")), escape_html(text), percent(F.col("confidence")),
             escape_html(ranges), escape_html(F.coalesce("tracking_method", F.lit("")))]
    parts = [F.lit("<tr>")]
    for cell in cells:
        parts += [F.lit("<td>"), cell, F.lit("</td>")]
    return F.concat(*parts, F.lit("</tr>"))


def html_report(summary: DataFrame, audit: DataFrame, generated_at: Column) -> DataFrame:
    """Report lines (project_id, section, event_id, line) of an HTML page."""
    name = escape_html(F.coalesce("project_name", F.lit("")))
    stat = lambda value, label: F.concat(
        F.lit('<div class="stat"><h3>'), F.col(value).cast("string"), F.lit(f"</h3><p>{label}</p></div>")
    )
    head = summary.select(
        "project_id", F.lit(HEADER).alias("section"), F.lit(None).cast("bigint").alias("event_id"),
        F.concat(
            F.lit("<!DOCTYPE html><html><head><title>Audit report: "), name, F.lit("</title></head><body><h1>"),
            name, F.lit("</h1><p>"), escape_html(generated_at), F.lit("</p><p>"),
            escape_html(F.coalesce("path", F.lit(""))), F.lit("</p>"),
            stat("total_events", "Total events found"), stat("accepted", "Redacted"), stat("rejected", "Rejected"),
            F.lit("<table><tr><th>PII Type</th><th>Detected Text</th><th>Confidence</th>"
                  "<th>Time Ranges</th><th>Tracking</th></tr>"),
        ).alias("line"),
    )
    body = audit.select("project_id", F.lit(BODY).alias("section"), "event_id", html_row().alias("line"))
    foot = summary.select(
        "project_id", F.lit(FOOTER).alias("section"), F.lit(None).cast("bigint").alias("event_id"),
        F.lit("</table></body></html>").alias("line"),
    )
    return head.unionByName(body).unionByName(foot)


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as text, one folder per project; file names follow the line order."""
    place = ["project_id", "section", "event_id"]
    (
        lines.repartitionByRange(*place).sortWithinPartitions(*place)
        .select("project_id", "line").write.mode("overwrite").partitionBy("project_id").text(path)
    )


def save_reports(lines: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Save the reports of any number of projects in a fixed number of buckets."""
    write_buckets(lines.select("project_id", "section", "event_id", "line"), path, "project_id", ["section", "event_id"], buckets)


def open_reports(spark: SparkSession, path: str, ids: Sequence[str] | None = None) -> DataFrame:
    """Saved report lines, of all projects or of some; `write_report` makes folders of a few."""
    return read_buckets(spark, path, _LINES, "project_id", ids)
