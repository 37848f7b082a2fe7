"""Queries on redaction, review state, settings, batches and reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.catalog.base import ORACLES, query, sql
from veilmark.catalog.detection import (
    _HITS, REGEX_RULES, document_hits, oracle_hits, oracle_spans,
)
from veilmark.functions import text as tx
from veilmark.functions.clock import age_seconds, iso_utc
from veilmark.operators import jobs as oj
from veilmark.operators import redact as rd
from veilmark.operators import review as rv
from veilmark.operators import settings as st
from veilmark.plans.ordered import chunk_by
from veilmark.plans.session import shared_folder
from veilmark.schemas import DEFAULT_OVERRIDES, DEFAULT_STYLE, PII_TYPES
from veilmark.sources import adapters as ad
from veilmark.sources import media, reports
from veilmark.sources.presets import BUILTIN as PRESETS
from veilmark.sources.presets import OVERRIDE_TYPES, builtin_presets
from veilmark.sources.projects import list_projects
from veilmark.sources.rules import builtin_rules, make_rule, rule_errors

KEY = ["project_id", "event_id"]

# ---- redaction -------------------------------------------------------------------------------


def redact_oracle(table: str, key: str, text: str, spans: str, piece: str) -> str:
    """Unite spans, then put the text together from the gaps and the replaced pieces."""
    return f"""
WITH sp AS ({spans}),
mk AS (SELECT {key}, s, e, max(e) OVER (PARTITION BY {key} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pe FROM sp),
gr AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe < s THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY s, e) g FROM mk),
un AS (SELECT {key}, g, min(s) s, max(e) e FROM gr GROUP BY ALL),
pv AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0) prev FROM un),
pc AS (SELECT {key}, count(*) n_spans, max(e) fin, string_agg(substring(t.{text}, (prev + 1)::INT, (s - prev)::INT)
         || (SELECT {piece} FROM (SELECT substring(t.{text}, (s + 1)::INT, (e - s)::INT) p)), '' ORDER BY s) body
       FROM pv JOIN {table} t USING ({key}) GROUP BY {key})
SELECT t.{key}, coalesce(pc.n_spans, 0)::INT n_spans,
  sha256(CASE WHEN pc.body IS NULL THEN t.{text} ELSE pc.body || substring(t.{text}, (fin + 1)::INT) END) redacted_hash
FROM {table} t LEFT JOIN pc USING ({key})"""


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "n_spans", F.sha2("redacted", 256).alias("redacted_hash"))


@query("redact_solid", redact_oracle(
    "documents", "doc_id", "text", oracle_spans("documents", "doc_id", "text", REGEX_RULES), "repeat('█', length(p))"))
def redact_solid(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    return _hashed(rd.redact_text(docs, "text", builtin_rules()), "doc_id")


@query("redact_pixelate", redact_oracle(
    "pages", "page_id", "html", oracle_spans("pages", "page_id", "html", REGEX_RULES),
    """(SELECT string_agg(CASE WHEN (i - 1) % 4 = 0 THEN substring(p, i::INT, 1) ELSE '█' END, '' ORDER BY i)
        FROM (SELECT unnest(range(1, length(p) + 1)) i))"""))
def redact_pixelate(spark: SparkSession, d: str) -> DataFrame:
    pages = ad.table(spark, d, "pages").select("page_id", "html")
    return _hashed(rd.redact_text(pages, "html", builtin_rules(), "pixelate", 4), "page_id")


@query("redact_custom", redact_oracle(
    "documents", "doc_id", "text",
    oracle_spans("documents", "doc_id", "text", [("email", "", "", "aie[a-z]*", "", 0, 0.9, None, "")]).replace(
        r"regexp_replace(text, '\p{L}', '_', 'g')", "text"), "repeat('█', length(p))"))
def redact_custom(spark: SparkSession, d: str) -> DataFrame:
    """A rule of one's own that has the id of a built-in one."""
    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    return _hashed(rd.redact_text(docs, "text", [make_rule("email", "aie[a-z]*")]), "doc_id")


_PROBLEMS = """SELECT DISTINCT concat(p_brand, ' ', p_size % 6) rule_id, CASE p_size % 6 WHEN 0 THEN concat('[', p_brand)
  WHEN 1 THEN concat('(', p_brand, '+)+') WHEN 2 THEN repeat(p_brand, 80) WHEN 3 THEN concat('(?P<a_b>', p_brand, ')')
  WHEN 4 THEN concat('[[', p_brand, ']') ELSE NULL END pattern FROM part"""


@query("rule_problems", f"""
SELECT rule_id, CASE WHEN pattern IS NULL THEN 'no pattern' WHEN length(pattern) > 500 THEN 'pattern exceeds 500 chars'
  WHEN starts_with(pattern, '(') THEN 'nested unbounded repetition' ELSE 'malformed regex' END problem
FROM ({_PROBLEMS}) WHERE pattern IS NULL OR NOT (starts_with(pattern, '(?') OR starts_with(pattern, '[['))""")
def rule_problems(spark: SparkSession, d: str) -> DataFrame:
    """Patterns made from the parts' brands, well formed or not."""
    ad.table(spark, d, "part").createOrReplaceTempView("part")
    rules = spark.sql(_PROBLEMS).selectExpr(
        "CAST(row_number() OVER (ORDER BY rule_id) AS INT) rule_ord", "rule_id", "'regex' type", "true enabled", "pattern")
    return rule_errors(spark, rules).withColumn("problem", F.regexp_extract("problem", "^[^:]*", 0))


_WORD = [("w", "", "", "aie[a-z]*", "", 0, 0.9, None, "")]


@query("redact_token", redact_oracle(
    "(SELECT conv_id * 1000 + turn turn_id, text FROM conversations)", "turn_id", "text",
    oracle_spans("(SELECT conv_id * 1000 + turn turn_id, text FROM conversations)", "turn_id", "text", _WORD).replace(
        r"regexp_replace(text, '\p{L}', '_', 'g')", "text"),
    "'[' || substring(sha256('salt' || p), 1, 12) || ']'"))
def redact_token(spark: SparkSession, d: str) -> DataFrame:
    turns = ad.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "text")
    rule = make_rule("w", "aie[a-z]*")
    return _hashed(rd.redact_text(turns, "text", [rule], "blur", salt="salt"), "turn_id")


@query("redact_accepted", redact_oracle(
    "documents", "doc_id", "text",
    "SELECT * FROM (" + oracle_spans("documents", "doc_id", "text", REGEX_RULES) + ") WHERE rule_id <> 'ipv4_address'",
    "repeat('█', length(p))"))
def redact_accepted(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.operators.classify import recogniser_spans

    docs = ad.table(spark, d, "documents").select("doc_id", "text")
    style = F.struct(
        F.lit("solid_box").alias("type"), F.lit(15).alias("strength"), F.lit("#000000").alias("color")
    )
    events = recogniser_spans(docs, "text", ["doc_id"]).select(
        "doc_id", "start", "end", style.alias("style"), F.col("start").alias("event_ord"),
        F.when(F.col("entity_type") == "IP_ADDRESS", "rejected").otherwise("accepted").alias("status"),
    )
    return _hashed(rd.redact_by_events(docs, ["doc_id"], "text", events), "doc_id")


@query("secure_view", sql("review", """
SELECT project_id, event_id, CASE WHEN status <> 'accepted' THEN extracted_text END extracted_text FROM review"""))
def secure_view(spark: SparkSession, d: str) -> DataFrame:
    return rd.secure_view(ad.review(spark, d), secure=F.col("status") == "accepted").select(*KEY, "extracted_text")


# ---- decisions and styles --------------------------------------------------------------------

@query("bulk_status", sql("review", """
SELECT project_id, event_id, CASE WHEN pii_type = 'ssn' THEN 'rejected' ELSE status END status, pii_type = 'ssn' updated
FROM review"""))
def bulk_status(spark: SparkSession, d: str) -> DataFrame:
    events = ad.review(spark, d)
    return rv.bulk_set_status(events, "rejected", events.filter("pii_type = 'ssn'")).select(*KEY, "status", "updated")


@query("set_statuses", sql("review", """
SELECT project_id, event_id, CASE WHEN confidence > 0.5 THEN 'accepted' ELSE status END status, confidence > 0.5 updated
FROM review"""))
def set_statuses(spark: SparkSession, d: str) -> DataFrame:
    events = ad.review(spark, d)
    updates = events.select(*KEY, F.when(F.col("confidence") > 0.5, "accepted").otherwise("maybe").alias("new_status"))
    return rv.set_statuses(events, updates).select(*KEY, "status", "updated")


@query("bad_statuses", sql("review", "SELECT project_id, event_id, 'maybe' new_status FROM review WHERE confidence <= 0.5"))
def bad_statuses(spark: SparkSession, d: str) -> DataFrame:
    events = ad.review(spark, d)
    updates = events.select(*KEY, F.when(F.col("confidence") > 0.5, "accepted").otherwise("maybe").alias("new_status"))
    return rv.bad_statuses(updates)


@query("bulk_style", sql("review", """
SELECT project_id, event_id, CASE WHEN pii_type = 'email' THEN 'pixelate' ELSE style_type END style_type,
  CASE WHEN pii_type = 'email' THEN 20 ELSE strength END strength, pii_type = 'email' updated FROM review"""))
def bulk_style(spark: SparkSession, d: str) -> DataFrame:
    events = ad.review(spark, d)
    look = {"type": "pixelate", "strength": 20, "color": "#112233"}
    return rv.bulk_set_style(events, look, events.filter("pii_type = 'email'")).select(
        *KEY, F.col("style.type").alias("style_type"), "style.strength", "updated"
    )


@query("add_delete", sql("review", """
SELECT project_id, event_id FROM review WHERE status <> 'rejected'
UNION ALL SELECT project_id, event_id + 1000000000 FROM review WHERE pii_type = 'phone'"""))
def add_delete(spark: SparkSession, d: str) -> DataFrame:
    events = ad.review(spark, d)
    added = events.filter("pii_type = 'phone'").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return rv.add_delete(events, added, events.filter("status = 'rejected'")).select(*KEY)


@query("auto_accept", sql("review", "SELECT project_id, event_id, 'accepted' status FROM review"))
def auto_accept(spark: SparkSession, d: str) -> DataFrame:
    return rv.auto_accept(ad.review(spark, d)).select(*KEY, "status")


@query("findings_view", sql("review", """
SELECT project_id, event_id, confidence, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, event_id) place
FROM review WHERE pii_type = 'phone' AND status = 'pending'"""))
def findings_view(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.plans.ordered import ranked

    seen = rv.filter_findings(ad.review(spark, d), "phone", "pending").withColumn("_down", -F.col("confidence"))
    return ranked(seen, ["project_id"], ["_down", "event_id"], "place", chunk_by("_down", 1)).select(
        *KEY, "confidence", "place"
    )


@query("findings_sorted", sql("review", "SELECT project_id, event_id, start_ms FROM review WHERE status = 'accepted'"))
def findings_sorted(spark: SparkSession, d: str) -> DataFrame:
    return rv.sort_findings(rv.filter_findings(ad.review(spark, d), status="accepted")).select(*KEY, "start_ms")


_GROUPS = """
SELECT project_id, pii_type || '::' || lower(coalesce(extracted_text, '')) group_key,
  arg_min(event_id, (start_ms, event_id)) representative, min(start_ms) first_start_ms, count(*) group_size,
  CASE WHEN min(status) = max(status) THEN min(status) ELSE 'mixed' END group_status,
  CASE WHEN min(status) = max(status) THEN min(status)
    ELSE concat(count(*) FILTER (status = 'accepted'), '/', count(*), ' accepted') END status_label
FROM review GROUP BY ALL"""


@query("findings_groups", sql("review", f"""
SELECT project_id, group_key, representative, first_start_ms, group_size FROM ({_GROUPS})"""))
def findings_groups(spark: SparkSession, d: str) -> DataFrame:
    return rv.group_findings(ad.review(spark, d)).select(
        "project_id", "group_key", "representative", "first_start_ms", "group_size"
    )


@query("group_status", sql("review", f"SELECT project_id, group_key, group_status, status_label FROM ({_GROUPS})"))
def group_status(spark: SparkSession, d: str) -> DataFrame:
    return rv.group_findings(ad.review(spark, d)).select("project_id", "group_key", "group_status", "status_label")


@query("status_counts", sql("review", """
SELECT project_id, count(*) FILTER (status = 'pending') pending, count(*) FILTER (status = 'accepted') accepted,
  count(*) FILTER (status = 'rejected') rejected FROM review GROUP BY ALL"""))
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return rv.status_counts(ad.review(spark, d), ["project_id"])


@query("accept_visible", sql("review", """
SELECT project_id, event_id, CASE WHEN pii_type = 'person' AND status = 'pending' THEN 'accepted' ELSE status END status
FROM review"""))
def accept_visible(spark: SparkSession, d: str) -> DataFrame:
    return rv.accept_visible(ad.review(spark, d), "person").select(*KEY, "status")


@query("reject_visible", sql("review", """
SELECT project_id, event_id, CASE WHEN pii_type = 'person' AND status = 'accepted' THEN 'rejected' ELSE status END status
FROM review"""))
def reject_visible(spark: SparkSession, d: str) -> DataFrame:
    return rv.reject_visible(ad.review(spark, d), "person", "accepted").select(*KEY, "status")


@query("style_group", sql("review", """
SELECT project_id, event_id, CASE WHEN coalesce(extracted_text, '') <> '' THEN 't:' || extracted_text
  ELSE 'e:' || event_id END style_group FROM review"""))
def style_group(spark: SparkSession, d: str) -> DataFrame:
    return rv.style_group(ad.review(spark, d)).select(*KEY, "style_group")


@query("restyle_groups", sql("review", """
SELECT project_id, event_id, CASE WHEN EXISTS (SELECT 1 FROM review c WHERE c.status = 'accepted'
    AND c.project_id = r.project_id AND (c.event_id = r.event_id OR c.extracted_text = r.extracted_text))
  THEN 'blur' ELSE style_type END style_type FROM review r"""))
def restyle_groups(spark: SparkSession, d: str) -> DataFrame:
    events = ad.review(spark, d)
    look = F.struct(F.lit("blur").alias("type"), F.lit(30).alias("strength"), F.lit("#000000").alias("color"))
    chosen = events.filter("status = 'accepted'").select(*KEY, look.alias("new_style"))
    return rv.restyle_groups(events, chosen).select(*KEY, F.col("style.type").alias("style_type"))


@query("non_customised", sql("review", """
SELECT project_id, event_id, CASE WHEN style_type = 'solid_box' THEN 'pixelate' ELSE style_type END style_type,
  CASE WHEN style_type = 'solid_box' THEN 9 ELSE strength END strength FROM review"""))
def non_customised(spark: SparkSession, d: str) -> DataFrame:
    new = {"type": "pixelate", "strength": 9, "color": "#000000"}
    return rv.restyle_uncustomised(ad.review(spark, d), DEFAULT_STYLE, new).select(
        *KEY, F.col("style.type").alias("style_type"), "style.strength"
    )


@query("style_impact", sql("review", """
SELECT project_id, count(*) FILTER (style_type = 'solid_box') affected, count(*) FILTER (style_type <> 'solid_box') customised,
  count(*) total FROM review GROUP BY ALL"""))
def style_impact(spark: SparkSession, d: str) -> DataFrame:
    return rv.style_impact(ad.review(spark, d), DEFAULT_STYLE, ["project_id"])


@query("timeline", sql("review", """
SELECT project_id, event_id, start_ms / 603000::DOUBLE * 100 start_pct,
  greatest(0.3::DOUBLE, end_ms / 603000::DOUBLE * 100 - start_ms / 603000::DOUBLE * 100) width_pct FROM review"""))
def timeline(spark: SparkSession, d: str) -> DataFrame:
    return rv.timeline_segments(ad.review(spark, d), F.lit(603_000)).select(*KEY, "start_pct", "width_pct")


@query("clock_formats", sql("review", """
SELECT project_id, event_id, CASE WHEN s >= 3600 THEN concat(s // 3600, ':', lpad((s // 60 % 60)::VARCHAR, 2, '0'), ':',
    lpad((s % 60)::VARCHAR, 2, '0')) ELSE concat(s // 60, ':', lpad((s % 60)::VARCHAR, 2, '0')) END clock,
  CASE WHEN s >= 3600 THEN concat(s // 3600, ':') ELSE '' END || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' ||
    lpad((s % 60)::VARCHAR, 2, '0') timecode
FROM (SELECT *, start_ms * 10 // 1000 s FROM review)"""))
def clock_formats(spark: SparkSession, d: str) -> DataFrame:
    ms = F.col("start_ms") * 10
    return ad.review(spark, d).select(*KEY, tx.clock(ms).alias("clock"), tx.clock(ms, True).alias("timecode"))


@query("split_event", sql("review", """
SELECT project_id, event_id, 0 part, start_ms, end_ms FROM review WHERE NOT (300000 > start_ms AND 300000 < end_ms)
  AND NOT (start_ms + 700 < end_ms)
UNION ALL SELECT project_id, event_id, 1, start_ms, start_ms + 700 FROM review WHERE start_ms + 700 < end_ms
UNION ALL SELECT project_id, event_id, 2, start_ms + 701, end_ms FROM review WHERE start_ms + 700 < end_ms"""))
def split_event(spark: SparkSession, d: str) -> DataFrame:
    return rv.split_event(ad.review(spark, d), F.col("start_ms") + 700).select(*KEY, "part", "start_ms", "end_ms")


@query("split_keyframes", sql("review", """
SELECT project_id, event_id, CASE WHEN start_ms + 700 < end_ms THEN CASE WHEN t <= start_ms + 700 THEN 1 ELSE 2 END ELSE 0 END part, t time_ms
FROM (SELECT *, unnest(generate_series(start_ms, end_ms, 500)) t FROM review)"""))
def split_keyframes(spark: SparkSession, d: str) -> DataFrame:
    events = ad.review(spark, d)
    kfs = events.select(*KEY, F.explode(F.sequence("start_ms", "end_ms", F.lit(500))).alias("time_ms"))
    parts = rv.split_event(events, F.col("start_ms") + 700)
    return rv.split_keyframes(kfs, parts).select(*KEY, "part", "time_ms")


# ---- action log ------------------------------------------------------------------------------

def _log(spark: SparkSession, d: str) -> DataFrame:
    """The event log as review actions: user = project, the number in `props` = event."""
    return ad.table(spark, d, "events").selectExpr(
        "CAST(user_id AS STRING) project_id", "CAST(get_json_object(props, '$.k') AS INT) event_id", "event_id seq",
        """CASE event_type WHEN 'click' THEN 'status' WHEN 'view' THEN 'status' WHEN 'error' THEN 'delete'
           WHEN 'purchase' THEN 'add' ELSE 'style' END kind""",
        "CASE WHEN value < 10 THEN 'accepted' WHEN value < 30 THEN 'rejected' ELSE 'pending' END after",
    )


_LOG = {"log": """
SELECT user_id::VARCHAR project_id, json_extract_string(props, '$.k')::INT event_id, event_id seq,
  CASE event_type WHEN 'click' THEN 'status' WHEN 'view' THEN 'status' WHEN 'error' THEN 'delete'
    WHEN 'purchase' THEN 'add' ELSE 'style' END kind,
  CASE WHEN value < 10 THEN 'accepted' WHEN value < 30 THEN 'rejected' ELSE 'pending' END after FROM events"""}


@query("replay_log", sql("", """
SELECT project_id, event_id, arg_max(after, seq) FILTER (kind = 'status') status, arg_max(after, seq) FILTER (kind = 'style') style,
  coalesce(arg_max(kind, seq) FILTER (kind IN ('add', 'delete')) <> 'delete', true) alive, count(*) n_actions
FROM log GROUP BY ALL""", _LOG))
def replay_log(spark: SparkSession, d: str) -> DataFrame:
    return rv.replay_log(_log(spark, d))


@query("undo_state", sql("", """
SELECT project_id, event_id, arg_max(after, seq) FILTER (kind = 'status') status, arg_max(after, seq) FILTER (kind = 'style') style,
  coalesce(arg_max(kind, seq) FILTER (kind IN ('add', 'delete')) <> 'delete', true) alive, count(*) n_actions
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) rn FROM log) WHERE rn > 7 GROUP BY ALL""", _LOG))
def undo_state(spark: SparkSession, d: str) -> DataFrame:
    return rv.replay_log(rv.undo(_log(spark, d), 7))


@query("undo_stack", sql("", """
SELECT project_id, seq, rn::INT undo_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) rn FROM log) WHERE rn <= 50""", _LOG))
def undo_stack(spark: SparkSession, d: str) -> DataFrame:
    return rv.undo_stack(_log(spark, d)).select("project_id", "seq", "undo_rank")


@query("redo_stack", sql("", """
SELECT project_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) rn,
  max(seq) FILTER (kind <> 'delete') OVER (PARTITION BY project_id) newest FROM log)
WHERE rn <= 5 AND kind = 'delete' AND (newest IS NULL OR seq > newest)""", _LOG))
def redo_stack(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    undone = rv.undo_stack(log, 5).filter("kind = 'delete'")
    return rv.redoable(log.filter("kind <> 'delete'"), undone).select("project_id", "seq")


# ---- settings, presets and rules -------------------------------------------------------------

_MATRIX = {"matrix": " UNION ALL ".join(
    f"SELECT '{p[0]}' preset_id, '{t}' pii_type, {dict(zip(OVERRIDE_TYPES, p[4:11])).get(t, p[3])}::DOUBLE threshold"
    for p in PRESETS for t in PII_TYPES)}


@query("thresholds", sql("spans entity_map", """
SELECT m.preset_id, e.pii_type, m.threshold, count(*) spans FROM spans JOIN entity_map e USING (entity_type)
JOIN matrix m USING (pii_type) GROUP BY ALL""", _MATRIX))
def thresholds(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.operators.classify import mapped_type

    used = ad.spans(spark, d).select(mapped_type(F.col("entity_type")).alias("pii_type")).groupBy("pii_type").agg(
        F.count("*").alias("spans")
    )
    return st.threshold_matrix(builtin_presets(spark)).join(used, "pii_type")


@query("preset_sweep", sql("spans entity_map", """
SELECT m.preset_id, video_id, e.pii_type, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END)::BIGINT kept, count(*) total
FROM spans JOIN entity_map e USING (entity_type) JOIN matrix m USING (pii_type) GROUP BY ALL""", _MATRIX))
def preset_sweep(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.operators.classify import mapped_type

    scored = ad.spans(spark, d).withColumn("pii_type", mapped_type(F.col("entity_type"))).filter("pii_type IS NOT NULL")
    return st.preset_sweep(scored, st.threshold_matrix(builtin_presets(spark)), ["video_id"])


@query("preset_totals", sql("spans entity_map", """
SELECT m.preset_id, e.pii_type, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END)::BIGINT kept,
  grouping(m.preset_id, e.pii_type)::INT level
FROM spans JOIN entity_map e USING (entity_type) JOIN matrix m USING (pii_type) GROUP BY CUBE (m.preset_id, e.pii_type)""", _MATRIX))
def preset_totals(spark: SparkSession, d: str) -> DataFrame:
    return st.preset_totals(preset_sweep(spark, d))


def _settings(spark: SparkSession, d: str) -> DataFrame:
    """Scan settings per customer."""
    return ad.table(spark, d, "customer").selectExpr(
        "CAST(c_custkey AS STRING) project_id", "c_mktsegment preset", "CAST(c_custkey % 7 + 1 AS INT) ocr_sample_interval",
        "1.0D ocr_resolution_scale", "CAST(c_custkey % 50 AS DOUBLE) / 100 confidence_threshold", "c_acctbal > 0 detect_faces",
        "c_nationkey = 3 secure_mode", "map('phone', CAST(c_nationkey AS DOUBLE) / 25, 'email', 0.4D) entity_confidence_overrides",
    )


_SETTINGS = """
SELECT c_custkey::VARCHAR project_id, c_custkey, c_mktsegment preset, (c_custkey % 7 + 1)::INT ocr_sample_interval,
  (c_custkey % 50)::DOUBLE / 100 confidence_threshold, c_acctbal > 0 detect_faces, c_nationkey = 3 secure_mode,
  c_nationkey::DOUBLE / 25 phone, c_nationkey FROM customer"""


@query("settings_patch", f"""
SELECT project_id, CASE WHEN c_nationkey < 10 THEN 9 ELSE ocr_sample_interval END ocr_sample_interval,
  CASE WHEN c_nationkey < 5 THEN NULL ELSE detect_faces END detect_faces,
  CASE WHEN c_nationkey < 10 THEN 0.9 ELSE phone END::DOUBLE phone,
  CASE WHEN c_nationkey < 10 THEN NULL ELSE 0.4 END::DOUBLE email, confidence_threshold FROM ({_SETTINGS})""")
def settings_patch(spark: SparkSession, d: str) -> DataFrame:
    fields = ["ocr_sample_interval", "detect_faces", "entity_confidence_overrides", "confidence_threshold"]
    nation = ad.table(spark, d, "customer").filter("c_nationkey < 10")
    patches = nation.selectExpr(
        "CAST(c_custkey AS STRING) project_id",
        """CASE WHEN c_nationkey < 5 THEN array('ocr_sample_interval', 'detect_faces', 'entity_confidence_overrides')
           ELSE array('ocr_sample_interval', 'entity_confidence_overrides') END given""",
        "9 ocr_sample_interval", "CAST(NULL AS BOOLEAN) detect_faces", "map('phone', 0.9D) entity_confidence_overrides",
        "0.77D confidence_threshold",
    )
    out = st.patch_settings(_settings(spark, d), patches, fields)
    return out.select(
        "project_id", "ocr_sample_interval", "detect_faces",
        F.try_element_at("entity_confidence_overrides", F.lit("phone")).alias("phone"),
        F.try_element_at("entity_confidence_overrides", F.lit("email")).alias("email"), "confidence_threshold",
    )


_PRESET_ROWS = {"ps": " UNION ALL ".join(
    f"SELECT '{p[0]}' preset_id, {p[1]} ivl, {p[3]}::DOUBLE thr, {p[4]}::DOUBLE phone, {str(p[11]).lower()} faces, {i} i"
    for i, p in enumerate(PRESETS))}


@query("apply_preset", sql("", f"""
SELECT s.project_id, coalesce(p.preset_id, s.preset) preset, coalesce(ivl, ocr_sample_interval)::INT ocr_sample_interval,
  coalesce(thr, confidence_threshold) confidence_threshold, coalesce(faces, detect_faces) detect_faces, secure_mode,
  coalesce(p.phone, s.phone) phone FROM ({_SETTINGS}) s LEFT JOIN ps p ON p.i = s.c_nationkey % 8""", _PRESET_ROWS))
def apply_preset(spark: SparkSession, d: str) -> DataFrame:
    presets = builtin_presets(spark)
    names = F.array(*[F.lit(p[0]) for p in PRESETS])
    chosen = ad.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("project_id"),
        F.get(names, F.col("c_nationkey") % 8).alias("preset_id"),
    ).filter("preset_id IS NOT NULL")
    out = st.apply_presets(_settings(spark, d), chosen, presets)
    return out.select(
        "project_id", "preset", "ocr_sample_interval", "confidence_threshold", "detect_faces", "secure_mode",
        F.try_element_at("entity_confidence_overrides", F.lit("phone")).alias("phone"),
    )


@query("set_override", f"""
SELECT project_id, 0.66::DOUBLE set_phone, NULL::DOUBLE reset_phone, 0.4::DOUBLE email, 2 n_set, 1 n_reset FROM ({_SETTINGS})""")
def set_override(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("entity_confidence_overrides")
    phone = F.lit("phone")
    changed = _settings(spark, d).select(
        "project_id", st.set_override(m, phone, F.lit(0.66)).alias("a"), st.reset_override(m, phone).alias("b")
    )
    return changed.select(
        "project_id", F.try_element_at("a", phone).alias("set_phone"), F.try_element_at("b", phone).alias("reset_phone"),
        F.try_element_at("b", F.lit("email")).alias("email"), F.size("a").alias("n_set"), F.size("b").alias("n_reset"),
    )


def _supplier_presets(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "supplier").selectExpr(
        "concat('p', s_suppkey % 60) preset_id", "s_name name", "s_suppkey % 3 = 0 builtin",
        "CAST(s_suppkey AS INT) preset_ord",
    )


_SUP = """SELECT concat('p', s_suppkey % 60) preset_id, s_name AS name, s_suppkey % 3 = 0 builtin, s_suppkey preset_ord FROM supplier"""


@query("preset_lookup", f"""
SELECT preset_id, arg_min(name, (NOT builtin, preset_ord)) AS name FROM ({_SUP}) GROUP BY ALL""")
def preset_lookup(spark: SparkSession, d: str) -> DataFrame:
    return st.effective_presets(_supplier_presets(spark, d)).select("preset_id", "name")


@query("preset_upsert", f"""
SELECT preset_id, name FROM ({_SUP}) WHERE NOT builtin AND preset_id NOT IN (SELECT preset_id FROM ({_SUP}) WHERE builtin)
UNION ALL SELECT preset_id, name FROM ({_SUP}) WHERE builtin""")
def preset_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _supplier_presets(spark, d)
    return st.upsert_presets(rows.filter("NOT builtin"), rows.filter("builtin")).select("preset_id", "name")


@query("preset_delete", f"""
SELECT preset_id, name FROM ({_SUP}) WHERE NOT builtin AND preset_id NOT IN (SELECT preset_id FROM ({_SUP}) WHERE builtin)""")
def preset_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = _supplier_presets(spark, d)
    return st.delete_presets(rows.filter("NOT builtin"), rows.filter("builtin")).select("preset_id", "name")


@query("preset_found", f"""
SELECT DISTINCT preset_id, preset_id IN (SELECT preset_id FROM ({_SUP}) WHERE NOT builtin) found FROM ({_SUP}) WHERE builtin""")
def preset_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _supplier_presets(spark, d)
    return st.found_presets(rows.filter("NOT builtin"), rows.filter("builtin"))


def _part_rules(spark: SparkSession, d: str) -> DataFrame:
    return ad.table(spark, d, "part").selectExpr(
        "CAST(p_partkey AS INT) rule_ord", "concat('r', p_partkey % 1500) rule_id", "p_name name",
        "CASE p_size % 5 WHEN 0 THEN 'regex' WHEN 1 THEN 'context' WHEN 2 THEN 'allowlist' WHEN 3 THEN 'denylist' ELSE 'field_label' END type",
        "p_partkey % 3 > 0 enabled", "p_brand pattern", "CAST(p_size AS INT) priority",
    )


_PART = """SELECT p_partkey::INT rule_ord, concat('r', p_partkey % 1500) rule_id, p_name AS name,
  CASE p_size % 5 WHEN 0 THEN 'regex' WHEN 1 THEN 'context' WHEN 2 THEN 'allowlist' WHEN 3 THEN 'denylist' ELSE 'field_label' END type,
  p_partkey % 3 > 0 enabled, p_brand pattern, p_size::INT priority FROM part"""


@query("rule_patch", f"""
SELECT rule_ord, rule_id, CASE WHEN rn = 1 AND p.rule_id IS NOT NULL THEN false ELSE enabled END enabled,
  CASE WHEN rn = 1 AND p.rule_id IS NOT NULL THEN NULL ELSE pattern END pattern, priority
FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY rule_ord) rn FROM ({_PART})) r
LEFT JOIN (SELECT DISTINCT rule_id FROM ({_PART}) WHERE priority > 40) p USING (rule_id)""")
def rule_patch(spark: SparkSession, d: str) -> DataFrame:
    rules = _part_rules(spark, d)
    patches = rules.filter("priority > 40").select("rule_id").distinct().select(
        "rule_id", F.array(F.lit("enabled"), F.lit("pattern")).alias("given"), F.lit(False).alias("enabled"),
        F.lit(None).cast("string").alias("pattern"), F.lit(99).alias("priority"),
    )
    return st.patch_rules(rules, patches, ["enabled", "pattern", "priority"]).select(
        "rule_ord", "rule_id", "enabled", "pattern", "priority"
    )


@query("rule_edits", f"""
SELECT rule_ord, rule_id FROM ({_PART}) WHERE rule_id NOT IN (SELECT rule_id FROM ({_PART}) WHERE type = 'denylist')
UNION ALL SELECT rule_ord, rule_id FROM ({_PART}) WHERE type = 'regex'""")
def rule_edits(spark: SparkSession, d: str) -> DataFrame:
    rules = _part_rules(spark, d)
    left = st.delete_rules(rules, rules.filter("type = 'denylist'"))
    return st.add_rules(left, rules.filter("type = 'regex'")).select("rule_ord", "rule_id")


@query("unknown_rules", f"""
SELECT concat('r', s_suppkey * 40) rule_id FROM supplier WHERE concat('r', s_suppkey * 40) NOT IN (SELECT rule_id FROM ({_PART}))""")
def unknown_rules(spark: SparkSession, d: str) -> DataFrame:
    wanted = ad.table(spark, d, "supplier").selectExpr("concat('r', s_suppkey * 40) rule_id")
    return st.unknown_rules(_part_rules(spark, d), wanted)


@query("active_rules", f"""
SELECT rule_ord, rule_id FROM ({_PART}) WHERE enabled AND type IN ('regex', 'context', 'field_label')""")
def active_rules(spark: SparkSession, d: str) -> DataFrame:
    return st.active(_part_rules(spark, d)).select("rule_ord", "rule_id")


@query("migrate", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false ELSE o_totalprice > 100000 END use_hw_encoder
FROM orders""")
def migrate(spark: SparkSession, d: str) -> DataFrame:
    settings = ad.table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END use_nvenc",
        "o_totalprice > 100000 use_hw_encoder",
    )
    return st.migrate_encoder_flag(settings)


@query("validate", sql("review", """
SELECT project_id, event_id, confidence * 1.2 > 1 bad_confidence, pii_type = 'ssn' bad_type, false bad_status,
  style_type = 'blur' bad_style, false bad_strength,
  NOT (confidence * 1.2 > 1 OR pii_type = 'ssn' OR style_type = 'blur') valid FROM review"""))
def validate(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.review(spark, d).withColumns({
        "confidence": F.col("confidence") * 1.2,
        "pii_type": F.when(F.col("pii_type") == "ssn", "social").otherwise(F.col("pii_type")),
        "style": F.when(F.col("style.type") == "blur", F.col("style").withField("type", F.lit("smear")))
        .otherwise(F.col("style")),
    })
    problems = st.event_problems()
    return st.validate(rows, problems).select(*KEY, *problems, "valid")


@query("validate_boxes", sql("boxes", """
SELECT video_id, frame_idx, box_ord, w - 80 < 1 bad_width, false bad_height, NOT (w - 80 < 1) valid FROM boxes"""))
def validate_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = ad.boxes(spark, d).select(
        "video_id", "frame_idx", "box_ord", (F.col("bbox.w") - 80).alias("w"), F.col("bbox.h").alias("h")
    )
    return st.validate(rows, st.box_problems()).drop("w", "h")


@query("quarantine", sql("review", "SELECT project_id, event_id FROM review WHERE confidence * 1.2 > 1"))
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    problems = st.event_problems()
    rows = ad.review(spark, d).withColumn("confidence", F.col("confidence") * 1.2)
    return st.split_valid(st.validate(rows, problems), problems)[1].select(*KEY)


# ---- sources ---------------------------------------------------------------------------------

@query("probe_metadata", sql("metas", """
SELECT doc_id, (24000 + 1000 * (doc_id % 7)) / 1001::DOUBLE fps, n_chars * 1000 + 500 duration_ms,
  (640 + doc_id * 13 % 1281)::INT width, (360 + doc_id * 7 % 721)::INT height, 'h264' codec, 'mp4' format FROM documents"""))
def probe_metadata(spark: SparkSession, d: str) -> DataFrame:
    return media.probe_metadata(ad.metas(spark, d))


@query("fingerprints", """
SELECT doc_id, sha256(text) file_hash, lang = 'en' changed FROM documents""")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    docs = ad.table(spark, d, "documents")
    now = docs.select("doc_id", F.sha2("text", 256).alias("file_hash"))
    stored = docs.select("doc_id", F.sha2(
        F.when(F.col("lang") == "en", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("file_hash"))
    return media.changed_files(now, stored, "doc_id")


@query("file_names", """
SELECT page_id, regexp_extract(path, '([^/]+)$', 1) AS name, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) extension
FROM (SELECT page_id, concat('/media/', page_id % 9, '/clip', page_id, (['.MP4','.mov','.txt','.WebM','.avi','.gif'])[(page_id % 6)::INT + 1]) path
      FROM pages) WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.mp4', '.mov', '.mkv', '.avi', '.webm')""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    files = ad.table(spark, d, "pages").selectExpr(
        "page_id", """concat('/media/', page_id % 9, '/clip', page_id,
           element_at(array('.MP4','.mov','.txt','.WebM','.avi','.gif'), CAST(page_id % 6 AS INT) + 1)) path""",
    )
    return media.with_name(files, F.col("path"), media.MEDIA_EXTENSIONS).select("page_id", "name", "extension")


@query("projects_list", """
SELECT c_custkey::VARCHAR project_id, c_name AS name, max(epoch_us(o_orderdate) // 1000) updated_ms, count(o_orderkey) event_count
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def projects_list(spark: SparkSession, d: str) -> DataFrame:
    orders = ad.table(spark, d, "orders")
    events = orders.select(F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderkey").alias("event_id"))
    latest = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("updated_at"))
    projects = ad.table(spark, d, "customer").join(latest, "c_custkey", "left").select(
        F.col("c_custkey").cast("string").alias("project_id"), F.col("c_name").alias("name"),
        F.lit(None).cast("timestamp").alias("created_at"), "updated_at", F.lit(None).cast("string").alias("video"),
    )
    return list_projects(projects, events).select(
        "project_id", "name", F.unix_millis("updated_at").alias("updated_ms"), F.col("event_count").cast("long").alias("event_count")
    )


@query("export_ages", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') started_at, (epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) // 1000000 age
FROM orders""")
def export_ages(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return ad.table(spark, d, "orders").select(
        "o_orderkey", iso_utc(at).alias("started_at"), age_seconds(at, F.to_timestamp(F.lit("2000-01-01"))).alias("age")
    )


@query("latest_export", """
SELECT o_custkey project_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) order_id FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def latest_export(spark: SparkSession, d: str) -> DataFrame:
    files = ad.table(spark, d, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("modified"),
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"),
                 F.when(F.col("o_orderstatus") == "P", ".mp4.tmp").otherwise(".mp4")).alias("path"),
    )
    return media.latest_exports(files).select("project_id", "order_id")


# ---- batches and reports ---------------------------------------------------------------------

@query("batch_summary", sql("batch", """
SELECT batch_id, count(*) total, count(*) FILTER (status = 'done') completed, count(*) FILTER (status = 'error') failed,
  sum(events_found)::BIGINT events_found,
  CASE WHEN count(*) FILTER (status IN ('done', 'error')) = count(*) THEN 'done' ELSE 'running' END batch_status
FROM batch GROUP BY ALL"""))
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return oj.batch_summary(ad.batch(spark, d), ["batch_id"])


@query("batch_pct", sql("batch", """
SELECT batch_id, item_id, CASE status WHEN 'importing' THEN 5 WHEN 'scanning' THEN 10 + scan_pct * 0.5::DOUBLE
  WHEN 'exporting' THEN 60 + export_pct * 0.4::DOUBLE WHEN 'done' THEN 100 ELSE 0 END::DOUBLE pct FROM batch"""))
def batch_pct(spark: SparkSession, d: str) -> DataFrame:
    return ad.batch(spark, d).select("batch_id", "item_id", oj.item_pct().alias("pct"))


@query("batch_scan", sql("boxes", """
SELECT v.video_id, CASE WHEN v.video_id = 'src3' THEN 'error' ELSE 'done' END status,
  CASE WHEN v.video_id = 'src3' THEN 'file not found' END error,
  CASE WHEN v.video_id = 'src3' THEN 0 ELSE coalesce(n, 0) END events_found
FROM (SELECT DISTINCT video_id FROM boxes) v LEFT JOIN (SELECT video_id, count(*) n FROM hits GROUP BY ALL) h USING (video_id)""", _HITS))
def batch_scan(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.operators.classify import regex_candidates

    boxes = ad.boxes(spark, d)
    videos = ad.table(spark, d, "documents").select(F.col("source").alias("video_id")).distinct()
    problem = F.when(F.col("video_id") == "src3", F.lit("file not found"))
    return oj.batch_scan(videos, boxes, problem, lambda b: regex_candidates(b, builtin_rules()))[1]


@query("audit_summary", sql("review", """
SELECT project_id, count(*) total_events, count(*) FILTER (status = 'accepted') accepted,
  count(*) FILTER (status = 'rejected') rejected, count(*) FILTER (status = 'pending') pending FROM review GROUP BY ALL"""))
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return oj.audit_summary(ad.review(spark, d), ["project_id"])


def _audit(spark: SparkSession, d: str) -> DataFrame:
    tracked = ad.review(spark, d).withColumn("tracking_method", F.lit("csrt"))
    return oj.audit_events(tracked, F.col("pii_type") == "ssn")


@query("audit_events", sql("review", """
SELECT project_id, event_id, pii_type, confidence, CASE WHEN pii_type <> 'ssn' THEN extracted_text END extracted_text,
  start_ms, end_ms, 'csrt' tracking_method, style_type redaction_style FROM review WHERE status = 'accepted'"""))
def audit_events(spark: SparkSession, d: str) -> DataFrame:
    return _audit(spark, d)


def _heads(spark: SparkSession, d: str) -> DataFrame:
    return oj.audit_summary(ad.review(spark, d), ["project_id"]).withColumns({
        "project_name": F.concat(F.lit("Case <"), "project_id", F.lit("> & 'co'")),
        "path": F.concat(F.lit("/v/"), "project_id", F.lit(".mp4")), "duration_ms": F.lit(603_000),
    })


_JS = """CASE WHEN {c} IS NULL THEN 'null' ELSE '"' || {c} || '"' END"""
_SUMS = """
SELECT project_id, count(*) total_events, count(*) FILTER (status = 'accepted') accepted,
  count(*) FILTER (status = 'rejected') rejected, count(*) FILTER (status = 'pending') pending FROM review GROUP BY ALL"""


@query("audit_json", sql("review", f"""
SELECT project_id, 0 section, NULL::BIGINT event_id, concat('{{"report_generated_at":"2024-01-01T00:00:00","project_id":"', project_id,
  '","project_name":"Case <', project_id, '> & ''co''","video":{{"path":"/v/', project_id, '.mp4","duration_ms":603000}},"summary":{{"total_events":',
  total_events, ',"accepted":', accepted, ',"rejected":', rejected, ',"pending":', pending, '}},"redacted_events":[') line FROM ({_SUMS})
UNION ALL
SELECT project_id, 1, event_id, concat(CASE WHEN event_id = min(event_id) OVER (PARTITION BY project_id) THEN '' ELSE ',' END,
  '{{"event_id":"', event_id, '","pii_type":"', pii_type, '","extracted_text":', {_JS.format(c="CASE WHEN pii_type <> 'ssn' THEN extracted_text END")},
  ',"time_ranges":[{{"start_ms":', start_ms, ',"end_ms":', end_ms, '}}],"tracking_method":"csrt","redaction_style":"', style_type, '"}}')
FROM review WHERE status = 'accepted'
UNION ALL SELECT project_id, 2, NULL, ']}}' FROM ({_SUMS})"""))
def audit_json(spark: SparkSession, d: str) -> DataFrame:
    lines = reports.json_report(_heads(spark, d), _audit(spark, d), F.lit("2024-01-01T00:00:00"))
    # Engines print doubles differently; the confidence is compared in audit_events.
    return lines.withColumn("line", F.regexp_replace("line", r'"confidence":[^,]*,', ""))


@query("audit_html", sql("review", """
SELECT project_id, event_id, concat('<tr><td>', pii_type, '</td><td>',
  CASE WHEN pii_type = 'ssn' OR extracted_text IS NULL THEN '[redacted]' ELSE extracted_text END, '</td><td>',
  round_even(confidence * 100, 0)::INT, '%</td><td>', start_ms, 'ms–', end_ms, 'ms</td><td>csrt</td></tr>') line
FROM review WHERE status = 'accepted'
UNION ALL
SELECT project_id, NULL, concat('<!DOCTYPE html><html><head><title>Audit report: Case &lt;', project_id,
  '&gt; &amp; &#x27;co&#x27;</title></head><body><h1>Case &lt;', project_id, '&gt; &amp; &#x27;co&#x27;</h1><p>2024</p><p>/v/', project_id,
  '.mp4</p><div class="stat"><h3>', count(*), '</h3><p>Total events found</p></div><div class="stat"><h3>',
  count(*) FILTER (status = 'accepted'), '</h3><p>Redacted</p></div><div class="stat"><h3>', count(*) FILTER (status = 'rejected'),
  '</h3><p>Rejected</p></div><table><tr><th>PII Type</th><th>Detected Text</th><th>Confidence</th><th>Time Ranges</th><th>Tracking</th></tr>')
FROM review GROUP BY project_id
UNION ALL SELECT DISTINCT project_id, NULL::BIGINT, '</table></body></html>' FROM review"""))
def audit_html(spark: SparkSession, d: str) -> DataFrame:
    return reports.html_report(_heads(spark, d), _audit(spark, d), F.lit("2024")).drop("section")


@query("saved_reports", ORACLES["audit_html"])
def saved_reports(spark: SparkSession, d: str) -> DataFrame:
    """HTML reports of all projects, saved in buckets and reopened."""
    path = shared_folder(spark)
    reports.save_reports(reports.html_report(_heads(spark, d), _audit(spark, d), F.lit("2024")), path)
    return reports.open_reports(spark, path).drop("section")


@query("saved_reviews", sql("review", """
SELECT project_id, event_id::VARCHAR event_id, pii_type, confidence, extracted_text, status, start_ms::BIGINT start_ms, end_ms::BIGINT end_ms,
  style_type, 0::BIGINT kf_ord, start_ms::BIGINT time_ms FROM review
UNION ALL
SELECT project_id, event_id::VARCHAR, pii_type, confidence, extracted_text, status, start_ms, end_ms, style_type, 1, end_ms
FROM review WHERE end_ms > start_ms"""))
def saved_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed events with a keyframe at each end, saved as documents and reopened."""
    from veilmark.sources.event_store import open_events, save_events

    events = ad.review(spark, d).withColumn("redaction_style", F.col("style"))
    box = [F.lit(v).alias(n) for n, v in zip("xywh", (1, 2, 3, 4))]
    marks = events.select(*KEY, F.explode(F.array_distinct(F.array("start_ms", "end_ms"))).alias("time_ms"), *box)
    path = shared_folder(spark)
    save_events(events, marks, path)
    kept, keyframes = open_events(spark, path)
    return kept.join(keyframes, KEY).select(
        *KEY, "pii_type", "confidence", "extracted_text", "status", F.col("time_ranges")[0]["start_ms"].alias("start_ms"),
        F.col("time_ranges")[0]["end_ms"].alias("end_ms"), F.col("redaction_style.type").alias("style_type"), "kf_ord", "time_ms",
    )


@query("detection_metrics", sql("boxes", """
SELECT toxic kind, count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) true_positives, count(*) FILTER (t IS NULL) false_positives,
  count(*) FILTER (f IS NULL) false_negatives,
  CASE WHEN count(*) FILTER (f IS NOT NULL) > 0 THEN count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) / count(*) FILTER (f IS NOT NULL)::DOUBLE END AS "precision",
  CASE WHEN count(*) FILTER (t IS NOT NULL) > 0 THEN count(*) FILTER (f IS NOT NULL AND t IS NOT NULL) / count(*) FILTER (t IS NOT NULL)::DOUBLE END AS recall
FROM (SELECT coalesce(fo.doc_id, tr.doc_id), coalesce(fo.toxic, tr.toxic) toxic, fo.doc_id f, tr.doc_id t
  FROM (SELECT DISTINCT h.frame_idx doc_id, l.toxic FROM hits h JOIN labels l ON l.doc_id = h.frame_idx) fo
  FULL JOIN (SELECT doc_id, toxic FROM labels WHERE quality = 0) tr ON tr.doc_id = fo.doc_id AND tr.toxic = fo.toxic) GROUP BY ALL""", _HITS))
def detection_metrics(spark: SparkSession, d: str) -> DataFrame:
    labels = ad.table(spark, d, "labels").withColumnRenamed("toxic", "kind")
    found = document_hits(spark, d).select(F.col("frame_idx").alias("doc_id")).distinct().join(labels, "doc_id")
    return oj.detection_metrics(found, labels.filter("quality = 0"), ["doc_id"], ["kind"])


@query("box_matching", sql("boxes", """
SELECT video_id, frame_idx, id true_id, id found_id, round(x / (2 * w * h - x)::DOUBLE, 9) iou FROM (
  SELECT video_id, frame_idx, box_ord id, w, h, greatest(0, w - 12) * 16 x FROM boxes) WHERE x / (2 * w * h - x)::DOUBLE >= 0.5"""))
def box_matching(spark: SparkSession, d: str) -> DataFrame:
    truth = ad.boxes(spark, d).select(
        "video_id", "frame_idx", F.lit("person").alias("pii_type"), F.col("box_ord").alias("id"), "bbox"
    )
    found = truth.withColumn("bbox", F.col("bbox").withField("x", F.col("bbox.x") + 12))
    return oj.match_boxes(found, truth).select(
        "video_id", "frame_idx", "true_id", "found_id", F.round("iou", 9).alias("iou")
    )


@query("corrections_per_minute", sql("", """
SELECT project_id, count(*) FILTER (kind = 'style') edits, count(*) FILTER (kind = 'style') * 60000.0::DOUBLE / 90000 per_minute
FROM log GROUP BY ALL""", _LOG))
def corrections_per_minute(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).withColumn("kind", F.when(F.col("kind") == "style", "keyframes").otherwise(F.col("kind")))
    videos = log.select("project_id").distinct().withColumn("duration_ms", F.lit(90_000))
    return oj.corrections_per_minute(log, videos)


__all__ = ["DEFAULT_OVERRIDES", "oracle_hits"]
