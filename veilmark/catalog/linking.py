"""Queries on linking, keyframes, regions and tracks."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.catalog.base import GAP_MS, LINKED, SUMMARY, TABLES, TOLERANCE_PX, link_tables, query, sql
from veilmark.catalog.detection import (
    _DIST, _PIXELS, captioned, dense_hists, faces, oracle_builtin_labels, oracle_candidates, oracle_captioned,
)
from veilmark.functions import geometry as geo
from veilmark.operators import link as ol
from veilmark.operators import regions as rg
from veilmark.operators import tracks as tk
from veilmark.plans.ordered import chunk_by, latest_before, ranked, running
from veilmark.sources import adapters as ad
from veilmark.sources.rules import builtin_rules

ORDER = ["time_ms", "cand_ord"]
# One frame per 1000 s suits a log whose rows are hours apart.
FPS = 0.001
PAD_MS = 2_000_000
WEEK = 7 * GAP_MS


def linked(spark: SparkSession, d: str, prior: bool = False) -> DataFrame:
    """The event log's candidates, linked over a day's silence and 400 px; with `prior` with the keyframe before."""
    return ol.link_candidates(
        ad.cands(spark, d), gap_ms=GAP_MS, tolerance_px=TOLERANCE_PX, chunk_ms=WEEK, prior=prior
    )


def summary(spark: SparkSession, d: str) -> DataFrame:
    return ol.event_summary(linked(spark, d))


# ---- linking ---------------------------------------------------------------------------------

@query("gap_islands", sql("cands", """
SELECT video_id, pii_type, time_ms, cand_ord,
  first_value(time_ms) OVER w island_ms, first_value(cand_ord) OVER w island_ord FROM li
WINDOW w AS (PARTITION BY video_id, pii_type, isl ORDER BY time_ms, cand_ord)""",
                          {k: LINKED[k] for k in ("lk", "li")}))
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    return ol.gap_islands(ad.cands(spark, d), GAP_MS, WEEK).select(
        *ol.KIND, *ORDER, F.col("island.time_ms").alias("island_ms"), F.col("island.cand_ord").alias("island_ord")
    )


@query("scene_cut_flag", sql("cands cuts", """
SELECT video_id, pii_type, time_ms, cand_ord, last_cut, coalesce(EXISTS (SELECT 1 FROM cuts u
  WHERE u.video_id = k.video_id AND u.cut_ms > k.p AND u.cut_ms < k.time_ms), false) cut_between
FROM lk k""", {"lk": link_tables("cands", True)["lk"]}))
def scene_cut_flag(spark: SparkSession, d: str) -> DataFrame:
    marked = latest_before(
        ad.cands(spark, d), ad.cuts(spark, d), ["video_id"], "time_ms", "cut_ms", "last_cut", WEEK
    )
    looked = running(marked, ol.KIND, ORDER, chunk_by("time_ms", WEEK), prior={"before_ms": F.col("time_ms")})
    return looked.select(
        *ol.KIND, *ORDER, "last_cut",
        F.coalesce(F.col("last_cut") > F.col("before_ms"), F.lit(False)).alias("cut_between"),
    )


@query("link_events", sql("linked", """
SELECT video_id, pii_type, time_ms, cand_ord, seed_ms, seed_ord, event_id FROM linked"""))
def link_events(spark: SparkSession, d: str) -> DataFrame:
    return linked(spark, d).select(*ol.KIND, *ORDER, "seed_ms", "seed_ord", "event_id")


@query("link_summary", sql("summary", "SELECT * FROM summary"))
def link_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d)


@query("link_with_cuts", sql("cands cuts", """
SELECT video_id, pii_type, time_ms, cand_ord, seed_ms, seed_ord FROM linked""", link_tables("cands", True)))
def link_with_cuts(spark: SparkSession, d: str) -> DataFrame:
    done = ol.link_candidates(
        ad.cands(spark, d), ad.cuts(spark, d), gap_ms=GAP_MS, tolerance_px=TOLERANCE_PX, chunk_ms=WEEK
    )
    return done.select(*ol.KIND, *ORDER, "seed_ms", "seed_ord")


@query("link_large", sql("cands_big", """
SELECT video_id, pii_type, seed_ms, seed_ord, max(time_ms) end_ms, count(*) n_keyframes FROM linked GROUP BY ALL""",
                         {**link_tables("(SELECT *, pii_type AS text FROM cands_big)")}))
def link_large(spark: SparkSession, d: str) -> DataFrame:
    found = ad.cands_big(spark, d).drop("confidence", "text")
    done = ol.link_candidates(found, gap_ms=GAP_MS, tolerance_px=TOLERANCE_PX, chunk_ms=30 * GAP_MS)
    return ol.event_summary(done).select(*ol.KIND, "seed_ms", "seed_ord", "end_ms", "n_keyframes")


@query("link_refined", sql("linked", """
SELECT video_id, pii_type, time_ms, cand_ord, seed_ms, seed_ord FROM linked"""))
def link_refined(spark: SparkSession, d: str) -> DataFrame:
    c = ad.cands(spark, d)
    extra = c.filter("pii_type = 'error' OR confidence < 0.1")
    rest = c.filter("NOT (pii_type = 'error' OR confidence < 0.1)")
    done = ol.relink_with_extra(rest, extra, gap_ms=GAP_MS, tolerance_px=TOLERANCE_PX, chunk_ms=WEEK)
    return done.select(*ol.KIND, *ORDER, "seed_ms", "seed_ord")


@query("finished_events", sql("summary", """
SELECT video_id, event_id, 'auto' source, pii_type, confidence, NULL::VARCHAR extracted_text, start_ms, end_ms,
  n_keyframes, 'csrt' tracking_method, 'solid_box' style_type, 15 strength, '#000000' color, 'pending' status
FROM summary"""))
def finished_events(spark: SparkSession, d: str) -> DataFrame:
    done = ol.finished_events(summary(spark, d), secure=True)
    return done.select(
        "video_id", "event_id", "source", "pii_type", "confidence", "extracted_text", "start_ms", "end_ms",
        "n_keyframes", "tracking_method", F.col("redaction_style.type").alias("style_type"),
        "redaction_style.strength", "redaction_style.color", "status",
    )


@query("ordered_events", sql("summary", """
SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, seed_ord) place FROM summary"""))
def ordered_events(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.plans.ordered import ranked

    placed = ranked(summary(spark, d), ["video_id"], ["start_ms", "seed_ord"], "place", chunk_by("start_ms", WEEK))
    return placed.select("video_id", "event_id", "place")


@query("replace_events", sql("summary", """
SELECT video_id, event_id FROM summary WHERE pii_type = 'error'
UNION ALL SELECT video_id, event_id FROM summary s WHERE NOT EXISTS
  (SELECT 1 FROM summary f WHERE f.pii_type = 'error' AND f.video_id = s.video_id)"""))
def replace_events(spark: SparkSession, d: str) -> DataFrame:
    stored = ol.finished_events(summary(spark, d))
    return ol.replace_events(stored, stored.filter("pii_type = 'error'")).select("video_id", "event_id")


@query("append_events", sql("summary", f"""
SELECT video_id, event_id FROM summary WHERE pii_type = 'error'
UNION ALL SELECT video_id, event_id FROM summary s WHERE NOT (start_ms >= 1704067200000
  AND end_ms <= 1704067200000 + {WEEK} AND EXISTS
  (SELECT 1 FROM summary f WHERE f.pii_type = 'error' AND f.video_id = s.video_id))"""))
def append_events(spark: SparkSession, d: str) -> DataFrame:
    stored = ol.finished_events(summary(spark, d))
    start = 1_704_067_200_000
    return ol.append_events(stored, stored.filter("pii_type = 'error'"), (start, start + WEEK)).select(
        "video_id", "event_id"
    )


@query("full_scan", sql("boxes", """
SELECT video_id, pii_type, min(time_ms) start_ms, max(time_ms) end_ms, max(confidence) confidence, count(*) n_keyframes,
  arg_min(text, (time_ms, cand_ord)) extracted_text, max(w) env_w FROM linked GROUP BY video_id, pii_type, event_id""", {
    "hits": oracle_candidates("(SELECT * FROM boxes WHERE confidence >= 0.25 AND length(text) > 0)"),
    "found": """SELECT video_id, pii_type, time_ms, confidence, x, y, w, h, text, frame_idx::BIGINT * 16777216
  + row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY rule_ord, box_ord, hit_no) cand_ord FROM hits""",
    **link_tables("found", gap=20_000, reach=80)}))
def full_scan(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.plans.scan import full_scan as plan

    rules = [r for r in builtin_rules() if r["type"] == "regex"]
    return plan(ad.boxes(spark, d), rules, gap_ms=20_000, chunk_ms=100_000).select(
        *ol.KIND, "start_ms", "end_ms", "confidence", "n_keyframes", "extracted_text", "env_w"
    )


def oracle_all_candidates(table: str) -> dict[str, str]:
    """Regex hits, values of the built-in label rules and faces over captioned boxes, numbered within the frame; `found`."""
    return {
        "captions": oracle_captioned(table),
        "seen": "SELECT * FROM captions WHERE confidence >= 0.25 AND length(text) > 0",
        "hits": oracle_candidates("seen"), "labelled": oracle_builtin_labels("seen"),
        "found": f"""
SELECT video_id, pii_type, time_ms, confidence, x, y, w, h, text, frame_idx::BIGINT * 16777216
  + row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY src, rule_ord, o1, o2) cand_ord FROM (
  SELECT 1 src, video_id, frame_idx, time_ms, pii_type, confidence, text, x, y, w, h, rule_ord, box_ord o1, hit_no o2 FROM hits
  UNION ALL SELECT 2, video_id, frame_idx, time_ms, pii_type, confidence, text, x, y, w, h, rule_ord, label_ord, box_ord
  FROM labelled l ANTI JOIN hits k USING (video_id, frame_idx, x, y, w, h)
  UNION ALL SELECT 3, video_id, frame_idx, trunc(frame_idx / 30::DOUBLE * 1000)::INT, 'face', confidence, '[face]', x, y, w, h, 0, 0, 0
  FROM ({_PIXELS}) WHERE confidence >= 0.35::DOUBLE AND w >= 10 AND h >= 10)""",
    }


_ODD_CUTS = {"cuts": "SELECT source video_id, doc_id * 500 + 250 cut_ms FROM documents WHERE doc_id % 7 = 3"}


def odd_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh document is followed by a cut."""
    return ad.table(spark, d, "documents").filter("doc_id % 7 = 3").select(
        F.col("source").alias("video_id"), (F.col("doc_id") * 500 + 250).alias("cut_ms")
    )


@query("full_scan_all", sql("boxes hists", """
SELECT video_id, pii_type, min(time_ms) start_ms, max(time_ms) end_ms, max(confidence) confidence, count(*) n_keyframes,
  arg_min(text, (time_ms, cand_ord)) extracted_text, max(w) env_w FROM linked GROUP BY video_id, pii_type, event_id""", {
    **oracle_all_candidates("boxes"), **_ODD_CUTS, **link_tables("found", True, gap=20_000, reach=80)}))
def full_scan_all(spark: SparkSession, d: str) -> DataFrame:
    """All built-in rules, faces and cuts in one plan."""
    from veilmark.plans.scan import full_scan as plan

    boxes = captioned(ad.boxes(spark, d))
    done = plan(boxes, builtin_rules(), None, faces(spark, d), odd_cuts(spark, d), gap_ms=20_000, chunk_ms=100_000)
    return done.select(*ol.KIND, "start_ms", "end_ms", "confidence", "n_keyframes", "extracted_text", "env_w")


_REGEX_FOUND = """SELECT video_id, pii_type, time_ms, confidence, x, y, w, h, text, frame_idx, frame_idx::BIGINT * 16777216
  + row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY rule_ord, box_ord, hit_no) cand_ord FROM hits"""


def _first_pass() -> dict[str, str]:
    """Linked candidates of the first pass of a refined scan, its tables named apart from those of the second."""
    tables = link_tables("found1", True, gap=20_000, reach=80)
    own = re.compile(r"\b(" + "|".join(tables) + r")\b")
    return {f"{name}1": own.sub(r"\g<1>1", body) for name, body in tables.items()}


@query("refined_scan", sql("boxes", """
SELECT video_id, pii_type, min(time_ms) start_ms, max(time_ms) end_ms, max(confidence) confidence, count(*) n_keyframes,
  arg_min(text, (time_ms, cand_ord)) extracted_text, max(w) env_w FROM linked GROUP BY video_id, pii_type, event_id""", {
    "hits": oracle_candidates("(SELECT * FROM boxes WHERE confidence >= 0.25 AND length(text) > 0)"),
    "all_found": _REGEX_FOUND, **_ODD_CUTS,
    "looked": "SELECT source video_id, doc_id::INT frame_idx FROM documents WHERE doc_id % 3 = 0",
    "found1": "SELECT * FROM all_found SEMI JOIN looked USING (video_id, frame_idx)",
    **_first_pass(),
    "ends": "SELECT video_id, min(time_ms) start_ms, max(time_ms) end_ms FROM linked1 GROUP BY video_id, pii_type, event_id",
    "around": """
SELECT DISTINCT video_id, f::INT frame_idx FROM (
  SELECT video_id, trunc(start_ms / 1000::DOUBLE * 2)::INT - k f FROM ends, range(1, 31) r(k)
  UNION ALL SELECT video_id, trunc(end_ms / 1000::DOUBLE * 2)::INT + k FROM ends, range(1, 31) r(k))
WHERE f >= 0 AND (video_id, f) NOT IN (SELECT video_id, frame_idx FROM looked)""",
    "further": """
SELECT video_id, frame_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 rn, count(*) OVER (PARTITION BY video_id) n
  FROM around)
WHERE n >= 5 AND (n <= 300 OR rn IN (SELECT floor(i * (n / 300::DOUBLE)) FROM range(0, 300) r(i)))""",
    "found": "SELECT * FROM found1 UNION ALL SELECT * FROM all_found SEMI JOIN further USING (video_id, frame_idx)",
    **link_tables("found", True, gap=20_000, reach=80)}))
def refined_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every third document is scanned first, then documents around the events found."""
    from veilmark.operators.sampling import sample_fixed
    from veilmark.plans.scan import refined_scan as plan

    frames = ad.table(spark, d, "documents").select(
        F.col("source").alias("video_id"), F.col("doc_id").cast("int").alias("frame_idx"))
    rules = [r for r in builtin_rules() if r["type"] == "regex"]
    done = plan(ad.boxes(spark, d), sample_fixed(frames, 3), rules, F.lit(2.0), cuts=odd_cuts(spark, d),
                gap_ms=20_000, chunk_ms=100_000)
    return done.select(*ol.KIND, "start_ms", "end_ms", "confidence", "n_keyframes", "extracted_text", "env_w")


@query("saved_scan", sql("linked", """
SELECT l.video_id, l.event_id, l.pii_type, s.confidence, s.extracted_text, s.start_ms, s.end_ms, 'pending' status,
  row_number() OVER (PARTITION BY l.video_id, l.event_id ORDER BY l.time_ms, l.cand_ord) - 1 kf_ord, l.time_ms, l.x, l.y, l.w, l.h
FROM linked l JOIN (SELECT event_id, max(confidence) confidence, arg_min(text, (time_ms, cand_ord)) extracted_text,
  min(time_ms) start_ms, max(time_ms) end_ms FROM linked GROUP BY ALL) s USING (event_id)"""))
def saved_scan(spark: SparkSession, d: str) -> DataFrame:
    """Linked events saved as documents with their keyframes and reopened."""
    from veilmark.plans.session import shared_folder
    from veilmark.sources.event_store import open_events, save_events

    marks = linked(spark, d)
    path = shared_folder(spark)
    save_events(ol.finished_events(ol.event_summary(marks)), marks, path, "video_id", ORDER, chunk_ms=WEEK)
    events, keyframes = open_events(spark, path, "video_id")
    return events.join(keyframes, ["video_id", "event_id"]).select(
        "video_id", "event_id", "pii_type", "confidence", "extracted_text", F.col("time_ranges")[0]["start_ms"].alias("start_ms"),
        F.col("time_ranges")[0]["end_ms"].alias("end_ms"), "status", "kf_ord", "time_ms", "x", "y", "w", "h",
    )


@query("batch_scan_events", sql("boxes hists", """
SELECT v.video_id, CASE WHEN v.video_id = 'src3' THEN 'error' ELSE 'done' END status,
  CASE WHEN v.video_id = 'src3' THEN 'file not found' END error,
  CASE WHEN v.video_id = 'src3' THEN 0 ELSE coalesce(n, 0) END events_found
FROM (SELECT DISTINCT source video_id FROM documents) v
LEFT JOIN (SELECT video_id, count(DISTINCT event_id) n FROM linked GROUP BY ALL) USING (video_id)""", {
    **oracle_all_candidates("boxes"), **_ODD_CUTS, **link_tables("found", True, gap=20_000, reach=80)}))
def batch_scan_events(spark: SparkSession, d: str) -> DataFrame:
    """A batch whose items count linked events; one video cannot be opened."""
    from veilmark.operators.jobs import batch_scan
    from veilmark.plans.scan import full_scan as plan

    videos = ad.table(spark, d, "documents").select(F.col("source").alias("video_id")).distinct()
    problem = F.when(F.col("video_id") == "src3", F.lit("file not found"))
    cuts = odd_cuts(spark, d)
    return batch_scan(videos, captioned(ad.boxes(spark, d)), problem, lambda b: plan(
        b, builtin_rules(), cuts=cuts, gap_ms=20_000, chunk_ms=100_000
    ))[1]


# ---- boundary frames -------------------------------------------------------------------------

@query("boundary_frames", sql("summary", f"""
SELECT DISTINCT video_id, f::INT frame_idx FROM (
  SELECT video_id, trunc(start_ms / 1000::DOUBLE * {FPS}::DOUBLE)::INT - k f FROM summary, range(1, 31) r(k)
  UNION ALL
  SELECT video_id, trunc(end_ms / 1000::DOUBLE * {FPS}::DOUBLE)::INT + k FROM summary, range(1, 31) r(k))
WHERE f >= 0 AND (video_id, f) NOT IN
  (SELECT video_id, trunc(time_ms / 1000::DOUBLE * {FPS}::DOUBLE)::INT FROM cands)"""))
def boundary_frames(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.functions.numeric import ms_to_frame
    from veilmark.operators.sampling import boundary_frames as op

    sampled = ad.cands(spark, d).select("video_id", ms_to_frame(F.col("time_ms"), F.lit(FPS)).alias("frame_idx"))
    return op(summary(spark, d), sampled, F.lit(FPS))


@query("even_subsample", sql("cands_big", """
SELECT video_id, frame_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 rn, count(*) OVER (PARTITION BY video_id) n
  FROM (SELECT DISTINCT video_id, (time_ms // 86400000)::INT frame_idx FROM cands_big))
WHERE n >= 5 AND (n <= 300 OR rn IN (SELECT floor(i * (n / 300::DOUBLE)) FROM range(0, 300) r(i)))"""))
def even_subsample(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.operators.sampling import even_subsample as op

    frames = ad.cands_big(spark, d).select(
        "video_id", F.floor(F.col("time_ms") / 86_400_000).cast("int").alias("frame_idx")
    ).distinct()
    return op(frames, chunk_frames=512)


# ---- regions ---------------------------------------------------------------------------------

def covered_frames(spark: SparkSession, d: str, kfs: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    kfs = linked(spark, d, prior=True) if kfs is None else kfs
    return rg.event_frames(kfs, FPS, ORDER, PAD_MS, F.lit(1920), F.lit(1080), chunk_ms=WEEK, within=within)


def ranked_frames(spark: SparkSession, d: str) -> DataFrame:
    """Covered frames with the order of their event, those of a video's span together."""
    return rg.event_frames(
        linked(spark, d, prior=True), FPS, ORDER, PAD_MS, F.lit(1920), F.lit(1080), chunk_ms=WEEK,
        carry={"event_ord": F.min("seed_ord")}, span=512,
    )


_FRAMES = {
    "ev": """
SELECT video_id, event_id, min(seed_ord) seed_ord, max(confidence) confidence, max(w) mw, max(h) mh,
  list({'t': time_ms, 'cx': x + w / 2::DOUBLE, 'cy': y + h / 2::DOUBLE} ORDER BY time_ms, cand_ord) k
FROM linked GROUP BY ALL""",
    "fr": f"""
SELECT *, (f / {FPS}::DOUBLE) * 1000 ft FROM (SELECT *, mw + 2 * trunc(mw * 0.2::DOUBLE)::INT ew,
  mh + 2 * trunc(mh * 0.2::DOUBLE)::INT eh,
  unnest(generate_series(greatest(0, trunc(k[1].t / 1000::DOUBLE * {FPS}::DOUBLE)::BIGINT - 2),
                         trunc(k[-1].t / 1000::DOUBLE * {FPS}::DOUBLE)::BIGINT + 2)) f FROM ev)""",
    "br": """
SELECT *, list_filter(range(1, len(k)), lambda i: k[i].t <= ft AND ft <= k[i + 1].t)[1] b FROM fr""",
    "ce": """
SELECT *, CASE WHEN ft <= k[1].t THEN k[1].cx WHEN ft >= k[-1].t THEN k[-1].cx
    ELSE k[b].cx + (k[b + 1].cx - k[b].cx) * ((ft - k[b].t) / (k[b + 1].t - k[b].t)) END cx,
  CASE WHEN ft <= k[1].t THEN k[1].cy WHEN ft >= k[-1].t THEN k[-1].cy
    ELSE k[b].cy + (k[b + 1].cy - k[b].cy) * ((ft - k[b].t) / (k[b + 1].t - k[b].t)) END cy FROM br""",
    "regions": """
SELECT video_id, event_id, seed_ord, confidence, f::INT frame_idx,
  greatest(0, least(trunc(cx - ew / 2::DOUBLE)::INT, 1920 - ew)) x,
  greatest(0, least(trunc(cy - eh / 2::DOUBLE)::INT, 1080 - eh)) y, ew w, eh h FROM ce""",
}


@query("interpolated_boxes", sql("linked", """
SELECT video_id, event_id, frame_idx, x, y, w, h FROM regions""", _FRAMES))
def interpolated_boxes(spark: SparkSession, d: str) -> DataFrame:
    return covered_frames(spark, d).drop("confidence")


@query("expand_frames", sql("linked", f"""
SELECT r.video_id, r.event_id, frame_idx FROM regions r
JOIN (SELECT event_id, min(time_ms) lo, max(time_ms) hi FROM linked GROUP BY ALL) s USING (event_id)
WHERE frame_idx BETWEEN trunc((lo - 1000000) / 1000::DOUBLE * {FPS}::DOUBLE)
                    AND trunc((hi + 1000000) / 1000::DOUBLE * {FPS}::DOUBLE)""", _FRAMES))
def expand_frames(spark: SparkSession, d: str) -> DataFrame:
    kfs = linked(spark, d, prior=True)
    ranges = ol.event_summary(kfs).select("video_id", "event_id", "start_ms", "end_ms")
    return covered_frames(spark, d, kfs, rg.frame_limits(ranges, FPS, 1_000_000)).select(
        "video_id", "event_id", "frame_idx"
    )


@query("frames_in_range_lists", sql("summary", f"""
SELECT video_id, event_id, frame_idx, frame_idx BETWEEN trunc(start_ms / 1000::DOUBLE * {FPS}::DOUBLE)
  AND trunc((start_ms + 5000000) / 1000::DOUBLE * {FPS}::DOUBLE)
  OR frame_idx BETWEEN trunc((end_ms - 5000000) / 1000::DOUBLE * {FPS}::DOUBLE)
  AND trunc(end_ms / 1000::DOUBLE * {FPS}::DOUBLE) active
FROM (SELECT *, unnest(generate_series(trunc(start_ms / 1000::DOUBLE * {FPS}::DOUBLE)::BIGINT,
                                       trunc(end_ms / 1000::DOUBLE * {FPS}::DOUBLE)::BIGINT)) frame_idx FROM summary)"""))
def frames_in_range_lists(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.functions.numeric import ms_to_frame

    rate = F.lit(FPS)
    both = F.array(
        F.struct(F.col("start_ms"), (F.col("start_ms") + 5_000_000).alias("end_ms")),
        F.struct((F.col("end_ms") - 5_000_000).alias("start_ms"), F.col("end_ms")),
    )
    frames = summary(spark, d).withColumn("frame_idx", F.explode(F.sequence(
        ms_to_frame(F.col("start_ms"), rate, "long"), ms_to_frame(F.col("end_ms"), rate, "long")
    )))
    return frames.select(
        "video_id", "event_id", "frame_idx",
        rg.frame_in_ranges(F.col("frame_idx"), both, rate).alias("active"),
    )


_MERGING = """
SELECT video_id, frame_idx, 0 step, list({'x1': x, 'y1': y, 'x2': x + w, 'y2': y + h, 'c': confidence,
  'o': seed_ord, 'ev': event_id, 'm': 1::BIGINT} ORDER BY seed_ord) st FROM regions GROUP BY ALL
UNION ALL
SELECT video_id, frame_idx, step + 1, list_append(
    list_filter(st, lambda e: e.o <> st[i].o AND e.o <> st[j].o),
    {'x1': least(st[i].x1, st[j].x1), 'y1': least(st[i].y1, st[j].y1), 'x2': greatest(st[i].x2, st[j].x2),
     'y2': greatest(st[i].y2, st[j].y2), 'c': greatest(st[i].c, st[j].c),
     'o': CASE WHEN best_i THEN st[i].o ELSE st[j].o END, 'ev': CASE WHEN best_i THEN st[i].ev ELSE st[j].ev END,
     'm': st[i].m + st[j].m})
FROM (SELECT *, st[i].c > st[j].c OR (st[i].c = st[j].c AND st[i].o < st[j].o) best_i FROM (
  SELECT *, pr[1] // 1000 i, pr[1] % 1000 j FROM (
    SELECT *, list_filter(flatten(list_transform(range(1, len(st)), lambda a: list_transform(range(a + 1, len(st) + 1),
        lambda b: a * 1000 + b))), lambda q:
      st[q // 1000].x2 + 15 >= st[q % 1000].x1 AND st[q % 1000].x2 + 15 >= st[q // 1000].x1 AND
      st[q // 1000].y2 + 15 >= st[q % 1000].y1 AND st[q % 1000].y2 + 15 >= st[q // 1000].y1) pr FROM mg)
  WHERE len(pr) > 0))"""


@query("merge_regions", sql("linked", """
SELECT video_id, frame_idx, e.ev event_id, e.c confidence, e.m members, e.x1 x, e.y1 y, e.x2 - e.x1 w, e.y2 - e.y1 h
FROM (SELECT video_id, frame_idx, unnest(st) e FROM (
  SELECT video_id, frame_idx, arg_max(st, step) st FROM mg GROUP BY ALL))""", {
    **_FRAMES,
    "mg": _MERGING,
}))
def merge_regions(spark: SparkSession, d: str) -> DataFrame:
    return rg.merge_regions(ranked_frames(spark, d))


@query("merge_with_polygons", sql("linked", """
SELECT video_id, frame_idx, event_id, 1::BIGINT members, x, y, w, h, true shaped FROM told WHERE shaped
UNION ALL
SELECT video_id, frame_idx, e.ev event_id, e.m members, e.x1 x, e.y1 y, e.x2 - e.x1 w, e.y2 - e.y1 h, false
FROM (SELECT video_id, frame_idx, unnest(st) e FROM (
  SELECT video_id, frame_idx, arg_max(st, step) st FROM mg GROUP BY ALL))""", {
    **_FRAMES,
    "told": "SELECT *, seed_ord % 3 = 0 shaped FROM regions",
    "mg": _MERGING.replace("FROM regions", "FROM told WHERE NOT shaped"),
}))
def merge_with_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Regions of every third event are polygons, which stay as they are."""
    ranked_regions = ranked_frames(spark, d)
    right, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    polygon = F.when(F.col("event_ord") % 3 == 0, F.array(F.array("x", "y"), F.array(right, F.col("y")), F.array(right, low)))
    merged = rg.merge_regions(ranked_regions.withColumn("polygon", polygon))
    return merged.select("video_id", "frame_idx", "event_id", "members", *"xywh", F.col("polygon").isNotNull().alias("shaped"))


@query("coverage", sql("linked", """
SELECT v.video_id, 2600 total_frames, coalesce(n, 0) covered_frames, coalesce(n, 0) / 2600::DOUBLE coverage
FROM (SELECT DISTINCT video_id FROM cands) v
LEFT JOIN (SELECT video_id, count(DISTINCT frame_idx) n FROM regions GROUP BY ALL) USING (video_id)""", _FRAMES))
def coverage(spark: SparkSession, d: str) -> DataFrame:
    videos = ad.cands(spark, d).select("video_id").distinct().withColumn("total_frames", F.lit(2600))
    return rg.redaction_coverage(covered_frames(spark, d), videos)


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return ad.cands(spark, d).select(
        F.col("cand_ord").alias("probe_id"), "video_id", (F.col("time_ms") + 3_600_000).alias("at_ms"),
        (F.col("x") + 40).alias("px"), (F.col("y") + 10).alias("py"),
    )


def _ranges(kfs: DataFrame) -> DataFrame:
    status = F.when(F.col("confidence") < 0.01, "rejected").otherwise("pending")
    return ol.event_summary(kfs).select(
        "video_id", "event_id", "start_ms", "end_ms", "seed_ord", status.alias("status")
    )


_PROBES = {
    "probes": """
SELECT cand_ord probe_id, video_id, time_ms + 3600000 at_ms, x + 40 px, y + 10 py FROM cands""",
    "active": """
SELECT p.*, s.event_id, s.seed_ord FROM probes p JOIN summary s ON s.video_id = p.video_id
 AND s.confidence >= 0.01 AND p.at_ms BETWEEN s.start_ms - PAD AND s.end_ms + PAD""",
}


def _probe_tables(pad: int) -> dict[str, str]:
    return {k: v.replace("PAD", str(pad)) for k, v in _PROBES.items()}


@query("active_at", sql("summary", "SELECT probe_id, event_id FROM active", _probe_tables(7_200_000)))
def active_at(spark: SparkSession, d: str) -> DataFrame:
    return rg.active_at(_probes(spark, d), _ranges(linked(spark, d)), 7_200_000, GAP_MS).select("probe_id", "event_id")


_AT = {
    **_probe_tables(7_200_000),
    "kl": """
SELECT event_id, max(w) mw, max(h) mh, list({'t': time_ms, 'x': x, 'y': y, 'w': w, 'h': h,
  'cx': x + w / 2::DOUBLE, 'cy': y + h / 2::DOUBLE} ORDER BY time_ms, cand_ord) k FROM linked GROUP BY ALL""",
    "pb": """
SELECT a.*, kl.*, list_filter(k, lambda e: e.t <= at_ms)[-1] b, list_filter(k, lambda e: e.t > at_ms)[1] n
FROM active a JOIN kl USING (event_id)""",
    "pc": """
SELECT *, CASE WHEN b IS NULL THEN n.cx WHEN n IS NULL THEN b.cx
    ELSE b.cx + (n.cx - b.cx) * ((at_ms - b.t) / (n.t - b.t)) END cx,
  CASE WHEN b IS NULL THEN n.cy WHEN n IS NULL THEN b.cy
    ELSE b.cy + (n.cy - b.cy) * ((at_ms - b.t) / (n.t - b.t)) END cy FROM pb""",
    "placed": """
SELECT video_id, event_id, at_ms, probe_id, px, py, seed_ord,
  CASE WHEN len(k) = 1 THEN k[1].x ELSE floor(cx - mw / 2::DOUBLE + 0.5)::INT END x,
  CASE WHEN len(k) = 1 THEN k[1].y ELSE floor(cy - mh / 2::DOUBLE + 0.5)::INT END y,
  CASE WHEN len(k) = 1 THEN k[1].w ELSE mw END w, CASE WHEN len(k) = 1 THEN k[1].h ELSE mh END h FROM pc""",
}


@query("box_at_time", sql("summary", "SELECT DISTINCT event_id, at_ms, x, y, w, h FROM placed", _AT))
def box_at_time(spark: SparkSession, d: str) -> DataFrame:
    kfs = linked(spark, d, prior=True)
    active = rg.active_at(_probes(spark, d), _ranges(kfs), 7_200_000, GAP_MS)
    return rg.box_at_time(active, kfs, ORDER, WEEK).select(
        "event_id", "at_ms", "bbox.x", "bbox.y", "bbox.w", "bbox.h"
    )


@query("hit_test", sql("summary", """
SELECT probe_id, arg_max(event_id, seed_ord) event_id FROM placed
WHERE px BETWEEN x AND x + w AND py BETWEEN y AND y + h GROUP BY ALL""", {**_AT, **_probe_tables(0)}))
def hit_test(spark: SparkSession, d: str) -> DataFrame:
    kfs = linked(spark, d, prior=True)
    return rg.hit_test(_probes(spark, d), _ranges(kfs), kfs, ORDER, "seed_ord", GAP_MS, WEEK)


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    """Linked keyframes with a shape: a quadrangle, for some kinds a triangle, for unsure ones none."""
    x, y, right, low = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    corners = [F.array(x, y), F.array(right, y), F.array(right, low), F.array(x, low)]
    shape = F.when(F.col("confidence") < 0.02, None).when(
        F.col("confidence") < 0.05, F.array(*corners[:3])
    ).otherwise(F.array(*corners))
    return linked(spark, d).select(
        "video_id", "event_id", *ORDER, geo.make_box(x, y, F.col("w"), F.col("h")).alias("bbox"),
        shape.alias("polygon"),
    )


_T = "(f - f0) / (f1 - f0)::DOUBLE"
_LERP = "trunc({a} + ({b} - {a}) * (" + _T + "))::INT"


@query("polygon_interpolation", sql("linked", f"""
SELECT event_id, f::INT frame_idx, x, y, w, h, array_to_string(list_transform(poly, lambda p: concat(p[1], ' ', p[2])), ',') polygon
FROM (
  SELECT event_id, fr f, x, y, w, h, poly FROM dr
  UNION ALL
  SELECT event_id, f, {_LERP.format(a='px', b='x')}, {_LERP.format(a='py', b='y')}, {_LERP.format(a='pw', b='w')},
    {_LERP.format(a='ph', b='h')}, CASE WHEN pp IS NOT NULL AND poly IS NOT NULL AND len(pp) = len(poly)
      THEN list_transform(range(1, len(pp) + 1), lambda i: [{_LERP.format(a='pp[i][1]', b='poly[i][1]')},
        {_LERP.format(a='pp[i][2]', b='poly[i][2]')}]) ELSE pp END
  FROM (SELECT *, unnest(range(f0 + 1, f1)) f FROM (SELECT *, fr f1, lag(fr) OVER w f0, lag(x) OVER w px, lag(y) OVER w py,
    lag(dr.w) OVER w pw, lag(h) OVER w ph, lag(poly) OVER w pp FROM dr
    WINDOW w AS (PARTITION BY event_id ORDER BY time_ms, cand_ord)) WHERE f0 IS NOT NULL)
  UNION ALL
  SELECT event_id, unnest(range(greatest(0, fr - 2), fr)), x, y, w, h, poly FROM dr WHERE first_one
  UNION ALL
  SELECT event_id, unnest(range(fr + 1, fr + 3)), x, y, w, h, poly FROM dr WHERE last_one)""", {"dr": f"""
SELECT event_id, time_ms, cand_ord, x, y, w, h, trunc(time_ms / 1000::DOUBLE * {FPS}::DOUBLE)::BIGINT fr,
  row_number() OVER (PARTITION BY event_id ORDER BY time_ms, cand_ord) = 1 first_one,
  row_number() OVER (PARTITION BY event_id ORDER BY time_ms DESC, cand_ord DESC) = 1 last_one,
  CASE WHEN confidence < 0.02 THEN NULL WHEN confidence < 0.05 THEN [[x, y], [x + w, y], [x + w, y + h]]
    ELSE [[x, y], [x + w, y], [x + w, y + h], [x, y + h]] END poly FROM linked"""}))
def polygon_interpolation(spark: SparkSession, d: str) -> DataFrame:
    frames = rg.polygon_frames(_drawn(spark, d), FPS, ORDER, PAD_MS, WEEK)
    text = F.array_join(F.transform("polygon", lambda p: F.concat_ws(" ", p[0].cast("string"), p[1].cast("string"))), ",")
    return frames.select("event_id", "frame_idx", "bbox.x", "bbox.y", "bbox.w", "bbox.h", text.alias("polygon"))


@query("pad_boxes", sql("boxes", """
SELECT video_id, frame_idx, box_ord, greatest(0, x - dx) x, greatest(0, y - dy) y,
  least(1920, x + w + dx) - greatest(0, x - dx) w, least(1080, y + h + dy) - greatest(0, y - dy) h,
  least(1920 - greatest(0, x - rx), w + 2 * rx) ow, least(1080 - greatest(0, y - ry), h + 2 * ry) oh
FROM (SELECT *, trunc(w * 0.2::DOUBLE)::INT dx, trunc(h * 0.2::DOUBLE)::INT dy,
        floor(w * 0.15::DOUBLE + 0.5)::INT rx, floor(h * 0.15::DOUBLE + 0.5)::INT ry FROM boxes)"""))
def pad_boxes(spark: SparkSession, d: str) -> DataFrame:
    b, fw, fh = F.col("bbox"), F.lit(1920), F.lit(1080)
    out = ad.boxes(spark, d).withColumn("p", geo.pad_box(b, fw, fh, 0.20)).withColumn(
        "o", geo.pad_overlay_box(b, fw, fh, 0.15)
    )
    return out.select("video_id", "frame_idx", "box_ord", "p.*", F.col("o.w").alias("ow"), F.col("o.h").alias("oh"))


@query("lerp_boxes", sql("linked", """
SELECT event_id, time_ms, cand_ord, trunc(px + (x - px) * 0.3::DOUBLE)::INT x, trunc(py + (y - py) * 0.3::DOUBLE)::INT y
FROM (SELECT *, lag(x) OVER k px, lag(y) OVER k py FROM linked
      WINDOW k AS (PARTITION BY event_id ORDER BY time_ms, cand_ord)) WHERE px IS NOT NULL"""))
def lerp_boxes(spark: SparkSession, d: str) -> DataFrame:
    pairs = rg.keyframe_pairs(linked(spark, d, prior=True), F.lit(FPS), ORDER, WEEK)
    mid = geo.lerp_box(F.col("a"), F.col("b"), F.lit(0.3))
    return pairs.select("event_id", F.col("b.time_ms"), "cand_ord", mid["x"].alias("x"), mid["y"].alias("y"))


@query("keyframe_pairs", sql("linked", f"""
SELECT event_id, p from_ms, time_ms to_ms, trunc(p / 1000::DOUBLE * {FPS}::DOUBLE)::INT start_frame,
  trunc(time_ms / 1000::DOUBLE * {FPS}::DOUBLE)::INT end_frame
FROM (SELECT *, lag(time_ms) OVER (PARTITION BY event_id ORDER BY time_ms, cand_ord) p FROM linked) WHERE p IS NOT NULL"""))
def keyframe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rg.keyframe_pairs(linked(spark, d, prior=True), F.lit(FPS), ORDER, WEEK).select(
        "event_id", F.col("a.time_ms").alias("from_ms"), F.col("b.time_ms").alias("to_ms"), "start_frame", "end_frame"
    )


@query("close_unions", sql("linked", """
SELECT event_id, time_ms, x + 80 + 15 >= px AND px + 80 + 15 >= x AND y + 20 + 15 >= py AND py + 20 + 15 >= y close,
  least(x, px) x, least(y, py) y, greatest(x, px) + 80 - least(x, px) w, greatest(y, py) + 20 - least(y, py) h
FROM (SELECT *, lag(x) OVER k px, lag(y) OVER k py FROM linked
      WINDOW k AS (PARTITION BY event_id ORDER BY time_ms, cand_ord)) WHERE px IS NOT NULL"""))
def close_unions(spark: SparkSession, d: str) -> DataFrame:
    pairs = rg.keyframe_pairs(linked(spark, d, prior=True), F.lit(FPS), ORDER, WEEK)
    a, b = F.col("a"), F.col("b")
    return pairs.select(
        "event_id", F.col("b.time_ms").alias("time_ms"), rg.rects_close(a, b).alias("close"), geo.box_union(a, b).alias("u")
    ).select("event_id", "time_ms", "close", "u.*")


@query("envelopes", sql("linked", """
SELECT event_id, max(w) + 2 * trunc(max(w) * 0.2::DOUBLE)::INT env_w, max(h) + 2 * trunc(max(h) * 0.2::DOUBLE)::INT env_h
FROM linked GROUP BY ALL"""))
def envelopes(spark: SparkSession, d: str) -> DataFrame:
    return rg.event_spans(linked(spark, d), ORDER).select(
        "event_id", rg.envelope_side(F.col("max_w")).alias("env_w"), rg.envelope_side(F.col("max_h")).alias("env_h")
    )


@query("upsert_keyframes", sql("linked", """
SELECT event_id, time_ms, CASE WHEN time_ms = lo THEN 5 ELSE x END x, CASE WHEN time_ms = lo THEN 6 ELSE y END y, w, h
FROM linked JOIN (SELECT event_id, min(time_ms) lo FROM linked GROUP BY ALL) USING (event_id)
UNION ALL SELECT event_id, max(time_ms) + 1000, 7, 8, 80, 20 FROM linked GROUP BY ALL"""))
def upsert_keyframes(spark: SparkSession, d: str) -> DataFrame:
    kfs = linked(spark, d).select("video_id", "event_id", "time_ms", "x", "y", "w", "h")
    ends = kfs.groupBy("video_id", "event_id").agg(F.min("time_ms").alias("lo"), F.max("time_ms").alias("hi"))
    edit = lambda t, seq, x, y: F.struct(
        t.alias("time_ms"), F.lit(seq).alias("edit_seq"), F.lit(x).alias("x"), F.lit(y).alias("y"),
        F.lit(80).alias("w"), F.lit(20).alias("h"),
    )
    edits = ends.select("video_id", "event_id", F.inline(F.array(
        edit(F.col("lo"), 1, 1, 2), edit(F.col("lo"), 2, 5, 6), edit(F.col("hi") + 1000, 3, 7, 8)
    )))
    return rg.upsert_keyframes(kfs, edits).select("event_id", "time_ms", "x", "y", "w", "h")


@query("manual_events", """
SELECT drawn_id, 'manual' source, 'accepted' status, x, y, w, h, n_points FROM (
  SELECT o_orderkey drawn_id, 0 n_points, floor(least(x1, x2) + 0.5)::INT x, floor(least(y1, y2) + 0.5)::INT y,
    floor(abs(x2 - x1) + 0.5)::INT w, floor(abs(y2 - y1) + 0.5)::INT h, abs(x2 - x1) ew, abs(y2 - y1) eh
  FROM (SELECT o_orderkey, o_custkey % 90 + 0.25::DOUBLE x1, o_orderkey % 70 + 0.5::DOUBLE y1,
    o_orderkey % 83 + 0.75::DOUBLE x2, o_custkey % 61 + 0.5::DOUBLE y2, o_orderstatus FROM orders) WHERE o_orderstatus <> 'P'
  UNION ALL
  SELECT o_orderkey, 3, px, py, qx - px, qy - py, qx - px, qy - py FROM (
    SELECT o_orderkey, floor(least(x1, x2) + 0.5)::INT px, floor(greatest(x1, x2) + 0.5)::INT qx,
      floor(least(y1, y2) + 0.5)::INT py, floor(greatest(y1, y2) + 0.5)::INT qy
    FROM (SELECT o_orderkey, o_custkey % 90 + 0.25::DOUBLE x1, o_orderkey % 70 + 0.5::DOUBLE y1,
      o_orderkey % 83 + 0.75::DOUBLE x2, o_custkey % 61 + 0.5::DOUBLE y2, o_orderstatus FROM orders)
    WHERE o_orderstatus = 'P'))
WHERE ew >= 10 AND eh >= 10""")
def manual_events(spark: SparkSession, d: str) -> DataFrame:
    drawn = ad.table(spark, d, "orders").selectExpr(
        "CAST(o_custkey AS STRING) video_id", "o_orderkey drawn_id", "1000 at_ms",
        "pmod(o_custkey, 90) + 0.25D x1", "pmod(o_orderkey, 70) + 0.5D y1", "pmod(o_orderkey, 83) + 0.75D x2",
        "pmod(o_custkey, 61) + 0.5D y2", "o_orderstatus",
    )
    corner = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"))
    drawn = drawn.withColumn("polygon", F.when(F.col("o_orderstatus") == "P", corner))
    return rg.manual_events(drawn).select(
        "drawn_id", "source", "status", "bbox.*", F.coalesce(F.size("polygon"), F.lit(0)).alias("n_points")
    )


@query("static_pins", sql("summary", """
SELECT event_id, 0 start_ms, (s.video_id::INT + 60000)::INT end_ms, 'none' tracking_method FROM summary s"""))
def static_pins(spark: SparkSession, d: str) -> DataFrame:
    videos = ad.cands(spark, d).select("video_id").distinct().withColumn(
        "duration_ms", F.col("video_id").cast("long") + 60_000
    )
    return rg.static_pins(summary(spark, d), videos).select("event_id", "start_ms", "end_ms", "tracking_method")


@query("output_sizes", sql("metas", """
SELECT doc_id, greatest(2, CASE r WHEN 'custom' THEN round_even(cw / 2::DOUBLE, 0) * 2 WHEN '720p' THEN round_even(w * (720 / h::DOUBLE) / 2, 0) * 2
  WHEN '1080p' THEN round_even(w * (1080 / h::DOUBLE) / 2, 0) * 2 WHEN '4K' THEN round_even(w * (2160 / h::DOUBLE) / 2, 0) * 2
  ELSE round_even(w / 2::DOUBLE, 0) * 2 END)::INT out_w,
  CASE r WHEN 'custom' THEN 333 // 2 * 2 WHEN '720p' THEN 720 WHEN '1080p' THEN 1080 WHEN '4K' THEN 2160
    ELSE greatest(2, round_even(h / 2::DOUBLE, 0) * 2) END::INT out_h
FROM (SELECT doc_id, 640 + doc_id * 13 % 1281 w, 360 + doc_id * 7 % 721 h, doc_id % 900 + 1 cw,
  (['match_input','720p','1080p','4K','custom'])[(doc_id % 5)::INT + 1] r FROM metas)"""))
def output_sizes(spark: SparkSession, d: str) -> DataFrame:
    from veilmark.sources.media import probe_metadata

    kinds = F.array(*[F.lit(v) for v in ("match_input", "720p", "1080p", "4K", "custom")])
    meta = probe_metadata(ad.metas(spark, d))
    w, h = rg.output_size(
        F.col("width"), F.col("height"), F.element_at(kinds, (F.col("doc_id") % 5).cast("int") + 1),
        F.col("doc_id") % 900 + 1, F.lit(333),
    )
    return meta.select("doc_id", w.cast("int").alias("out_w"), h.cast("int").alias("out_h"))


# ---- tracks ----------------------------------------------------------------------------------

_DENSE = """
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 f, hist,
  first_value(hist) OVER (PARTITION BY video_id ORDER BY frame_idx) ref FROM hists"""
_RUNS = {
    "dn": _DENSE,
    "dd": f"SELECT *, {_DIST.format(a='ref', b='hist')} drift FROM dn",
    "ds": """
SELECT *, sum(CASE WHEN drift > 0.395 THEN 1 ELSE 0 END) OVER w - coalesce(max(base) OVER w, 0) streak FROM (
  SELECT *, CASE WHEN drift <= 0.395 THEN sum(CASE WHEN drift > 0.395 THEN 1 ELSE 0 END) OVER w END base FROM dd
  WINDOW w AS (PARTITION BY video_id ORDER BY f)) WINDOW w AS (PARTITION BY video_id ORDER BY f)""",
}


@query("drift_stop", sql("hists", """
SELECT video_id, f::INT frame_idx FROM ds JOIN
  (SELECT video_id, coalesce(min(f) FILTER (streak >= 3), 1000000) stop_at FROM ds GROUP BY ALL) USING (video_id)
WHERE f < stop_at""", _RUNS))
def drift_stop(spark: SparkSession, d: str) -> DataFrame:
    tracks = tk.with_reference_drift(dense_hists(spark, d), ["video_id"], "frame_idx")
    return tk.drift_stop(tracks, ["video_id"], "frame_idx", 0.395, 3, 16).select("video_id", "frame_idx")


@query("drift_blend", sql("hists", """
SELECT video_id, f::INT frame_idx, round(drift, 9) drift FROM bl""", {
    "dn": _DENSE,
    "bl": f"""
SELECT video_id, f, hist ref, 0::DOUBLE drift FROM dn WHERE f = 0
UNION ALL
SELECT b.video_id, n.f, CASE WHEN n.f % 5 = 0 THEN list_transform(range(1, 65),
    lambda i: b.ref[i] * (1 - 0.4::DOUBLE) + n.hist[i] * 0.4::DOUBLE) ELSE b.ref END,
  {_DIST.format(a='b.ref', b='n.hist')}
FROM bl b JOIN dn n ON n.video_id = b.video_id AND n.f = b.f + 1"""}))
def drift_blend(spark: SparkSession, d: str) -> DataFrame:
    # The first frame is its own reference: its distance is zero up to the last bits of the root.
    done = tk.with_blended_drift(dense_hists(spark, d), ["video_id"], "frame_idx", every=5)
    drift = F.when(F.col("frame_idx") == 0, F.lit(0.0)).otherwise(F.round("drift", 9))
    return done.select("video_id", "frame_idx", drift.alias("drift"))


@query("drift_blend_long", sql("hists", """
SELECT f::INT frame_idx, round(drift, 9) drift FROM bl""", {
    "dn": """SELECT row_number() OVER (ORDER BY frame_idx, video_id) - 1 f, hist FROM hists""",
    "bl": f"""
SELECT f, hist ref, 0::DOUBLE drift FROM dn WHERE f = 0
UNION ALL
SELECT n.f, list_transform(range(1, 65), lambda i: b.ref[i] * (1 - 0.02::DOUBLE) + n.hist[i] * 0.02::DOUBLE),
  {_DIST.format(a='b.ref', b='n.hist')}
FROM bl b JOIN dn n ON n.f = b.f + 1"""}))
def drift_blend_long(spark: SparkSession, d: str) -> DataFrame:
    """One track of all histograms, blended at every frame, with chunks much shorter than the track."""
    hists = ad.hists(spark, d).select(F.when(F.size("hist") == 64, "all").alias("track"), "frame_idx", "video_id", "hist")
    placed = ranked(hists, ["track"], ["frame_idx", "video_id"], "rn", chunk_by("frame_idx", 512)).withColumn("n", (F.col("rn") - 1).cast("int"))
    done = tk.with_blended_drift(placed.select("track", "n", "hist"), ["track"], "n", every=1, alpha=0.02, chunk_marks=100)
    drift = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.round("drift", 9))
    return done.select(F.col("n").alias("frame_idx"), drift.alias("drift"))


@query("hold_last", sql("cands", """
SELECT video_id, cand_ord, hx x, hy y FROM hs JOIN
  (SELECT video_id, coalesce(min(cand_ord) FILTER (streak > 8), 100000000000) stop_at FROM hs GROUP BY ALL) USING (video_id)
WHERE cand_ord < stop_at""", {
    "h0": """SELECT video_id, cand_ord, CASE WHEN confidence >= 0.1 THEN x END bx, CASE WHEN confidence >= 0.1 THEN y END b_y FROM cands""",
    "h1": """SELECT *, sum(CASE WHEN bx IS NULL THEN 1 ELSE 0 END) OVER w seen, last_value(bx IGNORE NULLS) OVER w hx,
      last_value(b_y IGNORE NULLS) OVER w hy FROM h0 WINDOW w AS (PARTITION BY video_id ORDER BY cand_ord)""",
    "hs": """SELECT *, seen - coalesce(max(CASE WHEN bx IS NOT NULL THEN seen END) OVER
      (PARTITION BY video_id ORDER BY cand_ord), 0) streak FROM h1"""}))
def hold_last(spark: SparkSession, d: str) -> DataFrame:
    box = geo.make_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    tracks = ad.cands(spark, d).select("video_id", "cand_ord", F.when(F.col("confidence") >= 0.1, box).alias("bbox"))
    return tk.hold_last(tracks, ["video_id"], "cand_ord", limit=8, chunk_frames=2048).select(
        "video_id", "cand_ord", "bbox.x", "bbox.y"
    )


@query("stop_at_cut", sql("cands cuts", """
SELECT c.video_id, c.pii_type, c.time_ms, c.cand_ord FROM cands c JOIN (
  SELECT video_id, pii_type, (SELECT min(cut_ms) FROM cuts u WHERE u.video_id = s.video_id AND cut_ms > t0) stop_at
  FROM (SELECT video_id, pii_type, min(time_ms) t0 FROM cands GROUP BY ALL) s) USING (video_id, pii_type)
WHERE stop_at IS NULL OR time_ms < stop_at"""))
def stop_at_cut(spark: SparkSession, d: str) -> DataFrame:
    marks = ad.cuts(spark, d).withColumnRenamed("cut_ms", "cut_at")
    return tk.stop_at_cut(ad.cands(spark, d), marks, ol.KIND, "time_ms", WEEK).select(*ol.KIND, *ORDER)


@query("merge_tracks", sql("linked", """
SELECT event_id, time_ms, arg_min(x, (job_ord, pos)) x, arg_min(y, (job_ord, pos)) y FROM (
  SELECT event_id, cand_ord job_ord, p time_ms, px x, py y, 0 pos FROM jb
  UNION ALL SELECT event_id, cand_ord, (p + time_ms) // 2, (px + x) // 2, (py + y) // 2, 0 FROM jb WHERE pii_type <> 'view'
  UNION ALL SELECT event_id, cand_ord, time_ms, x, y, 0 FROM jb WHERE pii_type = 'click'
  UNION ALL SELECT event_id, cand_ord, time_ms, x, y, 1 FROM jb WHERE pii_type <> 'click')
GROUP BY ALL""", {"jb": """
SELECT * FROM (SELECT *, lag(time_ms) OVER k p, lag(x) OVER k px, lag(y) OVER k py FROM linked
  WINDOW k AS (PARTITION BY event_id ORDER BY time_ms, cand_ord)) WHERE p IS NOT NULL"""}))
def merge_tracks(spark: SparkSession, d: str) -> DataFrame:
    jobs = linked(spark, d, prior=True).withColumnRenamed("prior", "a").filter("a IS NOT NULL").withColumn(
        "job_ord", F.col("cand_ord")
    )
    half = lambda c: F.floor((F.col(f"a.{c}") + F.col(c)) / 2).cast("long" if c == "time_ms" else "int").alias(c)
    base = ["event_id", "job_ord"]
    start = jobs.select(*base, "a.*")
    middle = jobs.filter("pii_type <> 'view'").select(*base, half("time_ms"), *[half(c) for c in "xywh"])
    end = jobs.filter("pii_type = 'click'").select(*base, "time_ms", *"xywh")
    segments = start.unionByName(middle).unionByName(end)
    gaps = jobs.select(*base, F.struct("time_ms", *"xywh").alias("end_kf"))
    return tk.merge_tracks(segments, gaps).select("event_id", "time_ms", "x", "y")


@query("extend_ranges", sql("summary", """
SELECT event_id, CASE WHEN pii_type = 'error' THEN start_ms ELSE start_ms - 700 END start_ms, end_ms + 500 end_ms FROM summary"""))
def extend_ranges(spark: SparkSession, d: str) -> DataFrame:
    kfs = linked(spark, d)
    forward = kfs.select("event_id", (F.col("time_ms") + 500).alias("time_ms"))
    backward = kfs.filter("pii_type <> 'error'").select("event_id", (F.col("time_ms") - 700).alias("time_ms"))
    return tk.extend_ranges(ol.event_summary(kfs), forward, backward).select("event_id", "start_ms", "end_ms")


__all__ = ["SUMMARY", "TABLES", "covered_frames", "linked", "summary"]
