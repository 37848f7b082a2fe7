"""Linking: unit cases, comparison with a plain model, invariants, chunk independence."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.operators.link import (
    LinkRun, append_events, event_summary, finished_events, link_candidates, replace_events,
)


def ranges(linked):
    rows = event_summary(linked).orderBy("start_ms", "seed_ord").collect()
    return [(r.pii_type, r.start_ms, r.end_ms, r.n_keyframes) for r in rows]


@pytest.mark.parametrize("rows, expected", [
    ([(0, 100, 100)], [("phone", 0, 0, 1)]),
    ([(0, 100, 100), (100, 102, 101)], [("phone", 0, 100, 2)]),
    ([(0, 100, 100), (0, 600, 100)], [("phone", 0, 0, 1)] * 2),
    ([(0, 100, 100, "phone"), (0, 100, 100, "email")], [("phone", 0, 0, 1), ("email", 0, 0, 1)]),
    ([(0, 100, 100), (5000, 100, 100)], [("phone", 0, 0, 1), ("phone", 5000, 5000, 1)]),
    ([(0, 100, 100), (3000, 100, 100)], [("phone", 0, 3000, 2)]),
    ([(500, 100, 100, "phone"), (0, 100, 100, "email")], [("email", 0, 0, 1), ("phone", 500, 500, 1)]),
    ([(0, 100, 100), (100, 100, 120), (200, 100, 140)], [("phone", 0, 200, 3)]),
    ([(0, 100, 100), (100, 100, 120), (200, 100, 620)], [("phone", 0, 100, 2), ("phone", 200, 200, 1)]),
])
def test_unit_cases(make_cands, rows, expected):
    assert sorted(ranges(link_candidates(make_cands(rows)))) == sorted(expected)


def test_confidence_is_running_maximum(make_cands):
    linked = link_candidates(make_cands([(0, 100, 100, "phone", 0.6), (100, 100, 100, "phone", 0.9)]))
    assert event_summary(linked).first().confidence == 0.9


@pytest.mark.parametrize("times, cut, events", [
    ((1000, 2000), 1500, 2), ((1000, 2000), None, 1), ((2000, 3000), 500, 1), ((1000, 2000), 2000, 1),
    ((1000, 2000), 1000, 1),
])
def test_scene_cuts(spark, make_cands, times, cut, events):
    cuts = None if cut is None else spark.createDataFrame([("v", cut)], "video_id string, cut_ms long")
    linked = link_candidates(make_cands([(t, 100, 100) for t in times]), cuts)
    assert event_summary(linked).count() == events


def model(rows, cuts, gap, reach):
    """Greedy linking in plain Python: row index -> row that opened its event."""
    events, opened = [], {}
    for i, (t, x, y, kind) in sorted(enumerate(rows), key=lambda p: (p[1][0], p[0])):
        for e in events:
            near = (x - e["x"]) ** 2 + (y - e["y"]) ** 2 <= reach**2
            if e["kind"] == kind and t - e["t"] <= gap and near and not any(e["t"] < c < t for c in cuts):
                break
        else:
            e = {"kind": kind, "seed": i}
            events.append(e)
        e.update(t=t, x=x, y=y)
        opened[i] = e["seed"]
    return opened


@pytest.mark.parametrize("seed, chunk, warm", [(1, 4000, 4000), (2, 4000, 4000), (3, 6000, 4000), (4, 900_000, None), (5, 4000, 8000)])
def test_against_model(spark, make_cands, seed, chunk, warm):
    """Small chunks force wrong guesses at chunk borders, so the second walk is exercised too."""
    rng = random.Random(seed)
    rows = [
        (rng.randrange(0, 60_000, 250), rng.randrange(0, 300), rng.randrange(0, 200), rng.choice(["phone", "email"]))
        for _ in range(600)
    ]
    cuts = sorted(rng.sample(range(0, 60_000, 250), 4))
    frame = spark.createDataFrame([("v", c) for c in cuts], "video_id string, cut_ms long")
    linked = link_candidates(make_cands(rows), frame, chunk_ms=chunk, warm_ms=warm)
    found = {r.cand_ord: r.seed_ord for r in linked.collect()}
    assert found == model(rows, cuts, 4000, 80)


def test_repair_writes_the_redone_chunks_only(spark, make_cands, monkeypatch, tmp_path):
    """Chunks that guessed right are written once, whatever the number of rounds."""
    from veilmark.operators import link

    monkeypatch.setattr(link, "shared_folder", lambda s: str(tmp_path / "walk"))
    # One stretch where guesses go wrong, and a long quiet one after it.
    rng = random.Random(3)
    rows = [(rng.randrange(0, 24_000, 250), rng.randrange(0, 300), rng.randrange(0, 200)) for _ in range(240)]
    rows += [(t, 100, 100) for t in range(30_000, 430_000, 200)]
    linked = link_candidates(make_cands(rows), chunk_ms=4000, warm_ms=4000)
    assert {r.cand_ord: r.seed_ord for r in linked.collect()} == model([(*r, "phone") for r in rows], [], 4000, 80)
    walked = spark.read.parquet(str(tmp_path / "walk")).where("_state = 0")
    sizes = {r["_version"]: r["count"] for r in walked.groupBy("_version").count().collect()}
    assert sizes[0] == len(rows) and len(sizes) > 1
    assert all(n <= 240 for version, n in sizes.items() if version > 0)


def test_invariants(spark, make_cands):
    rng = random.Random(7)
    rows = [(rng.randrange(0, 200_000), rng.randrange(0, 900), rng.randrange(0, 600)) for _ in range(800)]
    linked = link_candidates(make_cands(rows), chunk_ms=8000).collect()
    assert sorted(r.cand_ord for r in linked) == list(range(800))
    by_event = {}
    for r in sorted(linked, key=lambda r: (r.time_ms, r.cand_ord)):
        by_event.setdefault(r.event_id, []).append(r)
    for kfs in by_event.values():
        for a, b in zip(kfs, kfs[1:]):
            assert b.time_ms - a.time_ms <= 4000
            assert (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 6400


def test_ids_do_not_depend_on_layout(make_cands):
    rng = random.Random(9)
    rows = [(rng.randrange(0, 50_000), rng.randrange(0, 400), 0) for _ in range(300)]
    ids = [
        {r.cand_ord: r.event_id for r in link_candidates(make_cands(rows).repartition(n), chunk_ms=c).collect()}
        for n, c in ((1, 4000), (5, 20_000), (3, None))
    ]
    assert ids[0] == ids[1] == ids[2]


def test_secure_mode_and_style(make_cands):
    done = finished_events(event_summary(link_candidates(make_cands([(0, 1, 1)]))), secure=True).first()
    assert done.extracted_text is None and done.status == "pending"
    assert done.redaction_style.type == "solid_box" and done.redaction_style.strength == 15


def test_replace_and_append(spark, make_cands):
    old = finished_events(event_summary(link_candidates(make_cands([(0, 1, 1), (90_000, 1, 1)]))))
    new = finished_events(event_summary(link_candidates(make_cands([(89_000, 1, 1)]))))
    assert replace_events(old, new).count() == 1
    assert append_events(old, new).count() == 3
    assert append_events(old, new, (80_000, 100_000)).count() == 2


def test_hot_key_spreads_over_tasks(spark):
    """One video and kind with all rows is split over its chunks."""
    rows = spark.range(40_000).select(
        F.lit("v").alias("video_id"), F.lit("phone").alias("pii_type"), (F.col("id") * 100).alias("time_ms"),
        F.col("id").alias("cand_ord"), F.lit(0.9).alias("confidence"), (F.col("id") % 3 * 500).cast("int").alias("x"),
        F.lit(0).alias("y"), F.lit(80).alias("w"), F.lit(20).alias("h"), F.lit("t").alias("text"),
    )
    linked = link_candidates(rows, chunk_ms=100_000)
    assert [r.n_keyframes for r in event_summary(linked).orderBy("seed_ord").collect()] == [13_334, 13_333, 13_333]


@pytest.mark.parametrize("seed", range(3))
def test_extended_run_equals_one_run_over_all(spark, seed):
    """New candidates open, bridge and reorder events over chunk borders, also in chunks that were empty."""
    rng = random.Random(seed)
    schema = "video_id string, pii_type string, time_ms long, cand_ord long, confidence double, x int, y int, w int, h int, text string"
    rows = [(f"v{rng.randrange(2)}", rng.choice(["phone", "email"]), rng.randrange(60_000), i, 0.5, rng.randrange(200), 0, 80, 20, "t") for i in range(400)]
    rows = [r for r in rows if not 20_000 <= r[2] < 26_000] + [("v0", "phone", 20_500 + 700 * i, 1000 + i, 0.5, 9, 0, 80, 20, "t") for i in range(8)]
    late = [r for r in rows if r[3] >= 1000 or r[3] % 9 == 0]
    early = [r for r in rows if r not in late]
    cuts = spark.createDataFrame([("v0", 15_000), ("v1", 44_000)], "video_id string, cut_ms long")
    options = {"cuts": cuts, "gap_ms": 900, "tolerance_px": 30, "chunk_ms": 2000}
    run = LinkRun(spark.createDataFrame(early, schema), **options)
    before = {tuple(r) for r in run.linked().collect()}
    run.extend(spark.createDataFrame(late[:20], schema))
    run.extend(spark.createDataFrame(late[20:], schema))
    assert {tuple(r) for r in run.linked().collect()} == {tuple(r) for r in link_candidates(spark.createDataFrame(rows, schema), **options).collect()}
    assert before == {tuple(r) for r in link_candidates(spark.createDataFrame(early, schema), **options).collect()}


def test_extension_walks_touched_chunks_only(spark, make_cands):
    """One new candidate in one of a hundred chunks writes that chunk, and no row of the others."""
    run = LinkRun(make_cands([(1000 * i, 100, 100) for i in range(500)]), gap_ms=400, chunk_ms=5000)
    extra = make_cands([(7100, 100, 100)]).withColumn("cand_ord", F.lit(9999).cast("long"))
    run.extend(extra)
    written = spark.read.parquet(run.versions.folder).where("_version > 0 AND _state = 0")
    assert {r._chunk for r in written.select("_chunk").distinct().collect()} == {1}
    assert run.linked().count() == 501


def test_extension_by_nothing_changes_nothing(spark, make_cands):
    run = LinkRun(make_cands([(0, 100, 100), (100, 100, 100)]))
    run.extend(make_cands([(0, 0, 0)]).limit(0))
    assert event_summary(run.linked()).first().n_keyframes == 2


def test_summary_and_stitching_move_few_rows(make_cands, monkeypatch):
    """Events are grouped without their long ids, and rows of events that no chunk border cuts are not joined."""
    import re

    from veilmark.operators import link

    monkeypatch.setattr(link, "_BROADCAST_ROWS", 0)
    linked = link_candidates(make_cands([(t, 100, 100) for t in range(0, 20_000, 500)]), chunk_ms=4000)
    text = event_summary(linked)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*event_id", text)
    assert "isnull(_ref" in text and "isnotnull(_ref" in text
    assert event_summary(linked).first().n_keyframes == 40


@pytest.mark.parametrize("chunk", [4000, 900_000])
def test_keyframe_before(make_cands, chunk):
    """The keyframe before is that of the event, over chunk borders too."""
    rng = random.Random(4)
    rows = [(rng.randrange(0, 60_000, 250), rng.randrange(0, 300), rng.randrange(0, 200)) for _ in range(300)]
    linked = link_candidates(make_cands(rows), chunk_ms=chunk, warm_ms=4000, prior=True).collect()
    last = {}
    for r in sorted(linked, key=lambda r: (r.time_ms, r.cand_ord)):
        assert r.prior == last.get(r.event_id)
        last[r.event_id] = (r.time_ms, r.x, r.y, r.w, r.h)
    assert len(last) < 300
