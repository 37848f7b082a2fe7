"""Regions, tracks and sampling against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from veilmark.functions import geometry as geo
from veilmark.operators import regions as rg
from veilmark.operators import sampling as sm
from veilmark.operators import tracks as tk
from veilmark.operators.link import link_candidates


def boxes_of(spark, *rects):
    return spark.createDataFrame(
        [("v", 0, f"e{i}", i, 0.5, *r) for i, r in enumerate(rects)],
        "video_id string, frame_idx int, event_id string, event_ord int, confidence double, x int, y int, w int, h int",
    )


@pytest.mark.parametrize("rects, expected", [
    ([(10, 10, 100, 50), (50, 10, 100, 50)], [(10, 10, 140, 50)]),
    ([(10, 10, 50, 20), (200, 10, 50, 20)], [(10, 10, 50, 20), (200, 10, 50, 20)]),
    ([(10, 10, 50, 20), (65, 10, 50, 20)], [(10, 10, 105, 20)]),
    ([(0, 0, 10, 10), (26, 0, 10, 10)], [(0, 0, 10, 10), (26, 0, 10, 10)]),
    ([(0, 0, 10, 10), (25, 0, 10, 10)], [(0, 0, 35, 10)]),
])
def test_merge_cases(spark, rects, expected):
    found = rg.merge_regions(boxes_of(spark, *rects)).collect()
    assert sorted((r.x, r.y, r.w, r.h) for r in found) == expected


def merge_model(rects, gap=15):
    rects = [list(r) for r in rects]
    again = True
    while again:
        again = False
        for i in range(len(rects)):
            for j in range(i + 1, len(rects)):
                a, b = rects[i], rects[j]
                if a[0] <= b[2] + gap and b[0] <= a[2] + gap and a[1] <= b[3] + gap and b[1] <= a[3] + gap:
                    rects[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    del rects[j]
                    again = True
                    break
            if again:
                break
    return sorted(tuple(r) for r in rects)


def test_merge_against_model(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for frame in range(60):
        rects = [
            (x := rng.randrange(0, 900), y := rng.randrange(0, 500), x + rng.randrange(1, 90), y + rng.randrange(1, 40))
            for _ in range(rng.randrange(1, 40))
        ]
        expected[frame] = merge_model(rects)
        rows += [("v", frame, f"e{i}", i, 0.5, r[0], r[1], r[2] - r[0], r[3] - r[1]) for i, r in enumerate(rects)]
    frame = spark.createDataFrame(rows, boxes_of(spark, (0, 0, 1, 1)).schema)
    found = {}
    for r in rg.merge_regions(frame).collect():
        found.setdefault(r.frame_idx, []).append((r.x, r.y, r.x + r.w, r.y + r.h))
    assert {k: sorted(v) for k, v in found.items()} == expected
    assert rg.merge_regions(frame).agg(F.sum("members")).first()[0] == len(rows)


def test_crowded_frame_is_held_by_cells(monkeypatch):
    """Of a frame that comes in many batches no more than a row a cell and the newest batch are held."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(rg, "_HELD_ROWS", 500)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 60, 20_000), rng.integers(0, 60, 20_000)
    batch = lambda i: pa.RecordBatch.from_pydict({
        "video_id": ["v"] * 100, "frame_idx": pa.array([7] * 100, pa.int64()), "event_id": [str(k) for k in range(i, i + 100)],
        "confidence": [k / 20_000 for k in range(i, i + 100)], "members": pa.array([1] * 100, pa.int64()),
        "x1": x[i:i + 100], "y1": y[i:i + 100], "x2": x[i:i + 100] + 5, "y2": y[i:i + 100] + 5, "rank": pa.array(range(i, i + 100), pa.int64()),
    })
    sizes, whole = [], rg._best_rows
    monkeypatch.setattr(rg, "_best_rows", lambda group, box, *rest: sizes.append(len(box["x1"])) or whole(group, box, *rest))
    names = ["video_id", "frame_idx", "event_id", "confidence", "members", *"xywh"]
    out = pa.Table.from_batches(rg._unite_frames(15, names)(batch(i) for i in range(0, 20_000, 100))).to_pylist()
    assert [(r["event_id"], r["members"], r["x"], r["w"]) for r in out] == [("19999", 20_000, int(x.min()), int(x.max() - x.min()) + 5)]
    assert max(sizes) <= 600


def test_merge_keeps_surest_event(spark):
    rows = boxes_of(spark, (0, 0, 10, 10), (20, 0, 10, 10), (40, 0, 10, 10)).withColumn(
        "confidence", F.when(F.col("event_ord") == 1, 0.9).otherwise(0.5)
    )
    assert [r.event_id for r in rg.merge_regions(rows).collect()] == ["e1"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return geo.make_box(*[F.lit(x) for x in v])


@pytest.mark.parametrize("a, b, t, expected", [
    ((10, 20, 100, 50), (50, 80, 200, 100), 0.0, (10, 20, 100, 50)),
    ((10, 20, 100, 50), (50, 80, 200, 100), 1.0, (50, 80, 200, 100)),
    ((0, 0, 100, 100), (100, 100, 200, 200), 0.5, (50, 50, 150, 150)),
])
def test_lerp(spark, a, b, t, expected):
    assert tuple(one(spark, geo.lerp_box(box(*a), box(*b), F.lit(t)))) == expected


def test_padding(spark):
    assert tuple(one(spark, geo.pad_box(box(0, 0, 50, 50), F.lit(100), F.lit(100), 0.2))) == (0, 0, 60, 60)
    assert tuple(one(spark, geo.pad_box(box(100, 100, 100, 50), F.lit(1920), F.lit(1080), 0.2))) == (80, 90, 140, 70)
    assert min(one(spark, geo.pad_box(box(0, 0, 0, 0), F.lit(100), F.lit(100), 0.2))) >= 0
    assert tuple(one(spark, geo.pad_overlay_box(box(10, 10, 50, 10), F.lit(1920), F.lit(1080), 0.15))) == (2, 8, 66, 14)


def frame_model(kfs, fps, pad_ms):
    """kfs: sorted (time_ms, x, y, w, h) -> {frame: (x, y)}"""
    env_w, env_h = max(k[3] for k in kfs), max(k[4] for k in kfs)
    env_w, env_h = env_w + 2 * int(env_w * 0.2), env_h + 2 * int(env_h * 0.2)
    pts = [(k[0], k[1] + k[3] / 2, k[2] + k[4] / 2) for k in kfs]
    pad = int(pad_ms / 1000 * fps)
    out = {}
    for f in range(max(0, int(pts[0][0] / 1000 * fps) - pad), int(pts[-1][0] / 1000 * fps) + pad + 1):
        t = f / fps * 1000
        if t <= pts[0][0]:
            c = pts[0][1:]
        elif t >= pts[-1][0]:
            c = pts[-1][1:]
        else:
            a, b = next((a, b) for a, b in zip(pts, pts[1:]) if a[0] <= t <= b[0])
            s = (t - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 0.0
            c = (a[1] + (b[1] - a[1]) * s, a[2] + (b[2] - a[2]) * s)
        out[f] = (int(c[0] - env_w / 2), int(c[1] - env_h / 2), env_w, env_h)
    return out


@pytest.mark.parametrize("fps", [30.0, 29.97, 7.5])
def test_event_frames_against_model(spark, make_cands, fps):
    rng = random.Random(11)
    rows, t = [], 500
    for _ in range(25):
        t += rng.choice([0, 33, 100, 250, 999, 2000])
        rows.append((t, 100 + rng.randrange(0, 40), 100 + rng.randrange(0, 30)))
    linked = link_candidates(make_cands(rows))
    assert linked.select("event_id").distinct().count() == 1
    frames = rg.event_frames(linked, fps, ["time_ms", "cand_ord"], chunk_ms=2000).collect()
    found = {r.frame_idx: (r.x, r.y, r.w, r.h) for r in frames}
    assert len(found) == len(frames)
    assert found == frame_model([(*r, 80, 20) for r in rows], fps, 750)


def test_polygons_hold_when_vertex_counts_differ(spark):
    schema = (
        "video_id string, event_id string, time_ms int, cand_ord int, bbox struct<x:int,y:int,w:int,h:int>,"
        "polygon array<array<int>>"
    )
    rows = [
        ("v", "e", 0, 0, (0, 0, 10, 10), [[0, 0], [10, 0], [10, 10]]),
        ("v", "e", 400, 1, (40, 0, 10, 10), [[40, 0], [50, 0], [50, 10]]),
        ("v", "e", 800, 2, (80, 0, 10, 10), [[80, 0], [90, 0]]),
    ]
    frames = rg.polygon_frames(spark.createDataFrame(rows, schema), 10.0, ["time_ms", "cand_ord"], 100, 500)
    found = {r.frame_idx: r.polygon for r in frames.collect()}
    assert found[2] == [[20, 0], [30, 0], [30, 10]] and found[6] == [[40, 0], [50, 0], [50, 10]]
    assert found[9] == [[80, 0], [90, 0]] and sorted(found) == list(range(10))


def test_even_output_sizes(spark):
    size = lambda w, h, res, cw=None, ch=None: tuple(spark.range(1).select(*[
        c.cast("int") for c in rg.output_size(F.lit(w), F.lit(h), F.lit(res), F.lit(cw).cast("int"), F.lit(ch).cast("int"))
    ]).first())
    assert size(1921, 1081, "match_input") == (1920, 1080)
    assert size(1920, 1080, "720p") == (1280, 720)
    assert size(1080, 1920, "1080p") == (608, 1080)
    assert size(10, 10, "custom", 333, 1) == (332, 2)
    assert size(10, 10, "custom", None, 5) == (10, 10)


# ---- tracks ----------------------------------------------------------------------------------

def track(spark, values, name="drift", kind="double"):
    return spark.createDataFrame(
        [("v", i, v) for i, v in enumerate(values)], f"video_id string, frame_idx int, {name} {kind}"
    )


@pytest.mark.parametrize("drifts, kept", [
    ([0.9] * 5 + [0.1] + [0.9] * 6 + [0.1], 11),
    ([0.9] * 3 + [None] + [0.9] * 3 + [0.1], 6),
    ([0.82] * 20, 20),
])
def test_drift_stop(spark, drifts, kept):
    rows = tk.drift_stop(track(spark, drifts), ["video_id"], "frame_idx", chunk_frames=4).collect()
    assert sorted(r.frame_idx for r in rows) == list(range(kept))


@pytest.mark.parametrize("misses, kept", [(20, 23), (21, 21)])
def test_hold_last(spark, misses, kept):
    values = [1] + [None] * misses + [7, 8]
    rows = tk.hold_last(track(spark, values, "bbox", "int"), ["video_id"], "frame_idx", chunk_frames=4).collect()
    held = {r.frame_idx: r.bbox for r in rows}
    assert sorted(held) == list(range(kept)) and held[20] == 1


def test_blended_reference_with_limited_depth(spark):
    """Old blends fade, so the bounded window agrees with the full recursion."""
    rng = random.Random(5)
    hists = [[rng.random() for _ in range(4)] for _ in range(130)]
    frame = spark.createDataFrame(
        [("v", i, h) for i, h in enumerate(hists)], "video_id string, frame_idx int, hist array<double>"
    )
    found = {r.frame_idx: r.drift for r in tk.with_blended_drift(frame, ["video_id"], "frame_idx", every=1).collect()}
    ref = hists[0]
    for i, h in enumerate(hists):
        shared = sum((a * b) ** 0.5 for a, b in zip(ref, h)) / (sum(ref) * sum(h)) ** 0.5
        assert found[i] == pytest.approx(max(0.0, 1 - shared) ** 0.5, abs=1e-6)
        if i > 0:
            ref = [a * 0.6 + b * 0.4 for a, b in zip(ref, h)]


def test_slowly_blended_reference_keeps_old_blends(spark):
    """With a small alpha far more blends than for the default still show."""
    rng = random.Random(6)
    hists = [[1000.0, 0.0, 0.0, 0.0]] + [[rng.random() for _ in range(4)] for _ in range(130)]
    frame = spark.createDataFrame(
        [("v", i, h) for i, h in enumerate(hists)], "video_id string, frame_idx int, hist array<double>"
    )
    tracked = tk.with_blended_drift(frame, ["video_id"], "frame_idx", every=1, alpha=0.05)
    found = {r.frame_idx: r.drift for r in tracked.collect()}
    ref = hists[0]
    for i, h in enumerate(hists):
        shared = sum((a * b) ** 0.5 for a, b in zip(ref, h)) / (sum(ref) * sum(h)) ** 0.5
        assert found[i] == pytest.approx(max(0.0, 1 - shared) ** 0.5, abs=1e-6)
        if i > 0:
            ref = [a * 0.95 + b * 0.05 for a, b in zip(ref, h)]


# ---- sampling --------------------------------------------------------------------------------

def sample_model(hists, interval, scene, motion):
    dist = lambda a, b: max(0.0, 1 - sum((p * q) ** 0.5 for p, q in zip(a, b)) / (sum(a) * sum(b)) ** 0.5) ** 0.5
    mad = lambda a, b: sum(abs(p - q) for p, q in zip(a, b)) / len(a)
    out, burst, nxt, prev, last = [], 0, 0, None, len(hists) - 1
    for f in range(len(hists)):
        if f != nxt and f != last:
            continue
        cut = prev is not None and dist(hists[prev], hists[f]) > scene
        if cut or (prev is not None and burst == 0 and mad(hists[prev], hists[f]) >= motion):
            burst = 8
        out.append((f, prev, cut, burst))
        prev = f
        if burst > 0:
            nxt, burst = f + max(1, interval // 2), burst - 1
        else:
            nxt = f + interval
    return out


@pytest.mark.parametrize("interval, n, chunk", [(3, 200, 16), (1, 50, 8), (5, 203, 7), (10, 400, 64), (2, 1, 16)])
def test_adaptive_sampling_against_model(spark, interval, n, chunk):
    rng = random.Random(interval * 100 + n)
    hists, base = [], [rng.random() for _ in range(6)]
    for _ in range(n):
        if rng.random() < 0.05:
            base = [rng.random() for _ in range(6)]
        hists.append([v + rng.random() * 0.15 for v in base])
    frames = spark.createDataFrame(
        [(v, i, h) for v in ("a", "b") for i, h in enumerate(hists)],
        "video_id string, frame_idx int, hist array<double>",
    )
    found = sm.adaptive_sample(frames, interval, 0.2, 0.12, chunk_frames=chunk).collect()
    expected = sample_model(hists, interval, 0.2, 0.12)
    for video in ("a", "b"):
        rows = sorted((r.frame_idx, r.prev_frame, r.scene, r.burst) for r in found if r.video_id == video)
        assert rows == expected


def test_histogram_of_nothing_is_zero(spark):
    values = spark.createDataFrame([("a", 999.0), ("b", 3.0), ("b", 3.5)], "k string, v double")
    rows = {r.k: r.hist for r in sm.intensity_histogram(values, ["k"], "v", 4, 0, 8).collect()}
    assert rows["a"] == [0.0] * 4 and rows["b"] == [0.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("n", [4, 5, 300, 301, 777, 4000])
def test_even_subsample(spark, n):
    frames = spark.range(n).select(F.lit("v").alias("video_id"), (F.col("id") * 3).cast("int").alias("frame_idx"))
    found = sorted(r.frame_idx for r in sm.even_subsample(frames, chunk_frames=256).collect())
    places = range(n) if n <= 300 else [int(i * (n / 300)) for i in range(300)]
    assert found == ([] if n < 5 else [p * 3 for p in places])


def test_scene_cut_lies_between_samples(spark):
    change = spark.createDataFrame([("v", 30, 60)], "video_id string, prev_frame int, frame_idx int")
    assert sm.scene_cut_times(change, F.lit(30.0)).first().cut_ms == 1500
    assert sm.scene_cut_times(change, F.lit(30.0), strict=True).first().cut_ms == 1000


def test_a_long_event_is_filled_by_many_tasks(spark):
    """Ten hours of one event: its gaps are dealt by event and hour, with the head sent along."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = spark.range(0, 36_000, 10).selectExpr(
            "'v' AS video_id", "'e' AS event_id", "CAST(id * 1000 AS INT) AS time_ms", "id AS cand_ord", "0.5D AS confidence",
            "CAST(id % 900 AS INT) AS x", "10 AS y", "80 AS w", "20 AS h")
        frames = rg.event_frames(keys, 2.0, ["time_ms", "cand_ord"])
        assert frames.select("frame_idx").distinct().count() == frames.count() >= 71_980
        used = frames.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(used) >= 4 and max(r["count"] for r in used) < 36_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("prior", [False, True])
def test_frames_of_ranges_are_cut_before_they_are_filled(spark, make_cands, prior):
    """Ranges that overlap, touch, lie apart, are empty or missing give the frames that filling and then cutting gives."""
    rng = random.Random(5)
    rows = [(t, 100 * kind, 100, str(kind)) for kind in range(6) for t in range(0, 30_000, rng.choice([700, 1300]))]
    linked = link_candidates(make_cands(rows), chunk_ms=8000, prior=prior)
    ids = {r.pii_type: r.event_id for r in linked.select("pii_type", "event_id").distinct().collect()}
    ranges = spark.createDataFrame([
        ("v", ids["0"], 1000, 5000), ("v", ids["0"], 4000, 9000), ("v", ids["0"], 9100, 9200), ("v", ids["0"], 20_000, 90_000),
        ("v", ids["1"], 9000, 1000), ("v", ids["2"], -500, 0), ("v", ids["3"], None, 4000), ("v", ids["4"], 2000, 2000),
    ], "video_id string, event_id string, start_ms long, end_ms long")
    order = ["time_ms", "cand_ord"]
    whole = rg.event_frames(linked, 10.0, order, chunk_ms=4000)
    cut = rg.event_frames(linked, 10.0, order, chunk_ms=4000, within=rg.frame_limits(ranges, 10.0, 100))
    expected = sorted(tuple(r) for r in rg.within_ranges(whole, ranges, 10.0, 100).collect())
    assert sorted(tuple(r) for r in cut.collect()) == expected
    assert {r[1] for r in expected} == {ids[k] for k in "0245"}
    text = cut._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("explode(sequence(run")]
    assert "Exchange" not in above and "Join" not in above


def test_boundary_frames_travel_as_bits(spark):
    """The frames around events, over borders of words and from frame 0, are told apart after the shuffle."""
    from veilmark.operators import sampling as sm

    rng = random.Random(8)
    events = [(f"v{i % 3}", 100 * rng.randrange(0, 900)) for i in range(40)]
    events = [(v, t, t + 100 * rng.randrange(0, 200)) for v, t in events] + [(None, 500, 500), ("v9", 0, 0), ("v9", None, 0)]
    sampled = [(f"v{rng.randrange(4)}", rng.randrange(0, 1200)) for _ in range(700)] + [(None, 6)]
    for reach in (1, 30, 200):
        found = sm.boundary_frames(
            spark.createDataFrame(events, "video_id string, start_ms long, end_ms long"),
            spark.createDataFrame(sampled, "video_id string, frame_idx int"), F.lit(10.0), reach,
        )
        text = found._jdf.queryExecution().executedPlan().toString()
        rows = [tuple(r) for r in found.collect()]
        around = {(v, f) for v, a, b in events for k in range(1, reach + 1)
                  for f in ([a // 100 - k] if a is not None else []) + [b // 100 + k] if f >= 0}
        # A null video was never sampled, as nulls are not equal.
        assert len(rows) == len(set(rows)) and set(rows) == around - {s for s in sampled if s[0] is not None}
        assert text.count("Exchange hashpartitioning") == 1 and text.index("Generate explode(") < text.index("Exchange")
    assert dict(found.dtypes) == {"video_id": "string", "frame_idx": "int"}


@pytest.mark.parametrize("chunk", [500, 3000, 3_600_000])
def test_boxes_at_times_with_ties_over_chunks(spark, make_cands, chunk):
    """Before, at, between and after keyframes, also where several have one time and chunks lie between them."""
    import math

    rng = random.Random(6)
    rows = [(t, rng.randrange(90), rng.randrange(60)) for t in (700, 700, 900, 2100, 2100, 2100, 2400, 5300, 5300, 8000)]
    times = [0, 699, 700, 701, 900, 1500, 2099, 2100, 2101, 2399, 3000, 4000, 5299, 5300, 7999, 8000, 8001, 20_000]
    linked = link_candidates(make_cands([*rows, (700, 800, 0, "email")]), tolerance_px=200, prior=True)
    ids = {r.pii_type: r.event_id for r in linked.select("pii_type", "event_id").distinct().collect()}
    asked = spark.createDataFrame([("v", e, t) for e in ids.values() for t in times for _ in "ab"], "video_id string, event_id string, at_ms long")
    marks = {}
    for t, x, y in rows:
        marks.setdefault(t, (x + 40, y + 10))

    def place(t):
        low, high = [k for k in marks if k <= t], [k for k in marks if k > t]
        if not low or not high:
            c = marks[min(high) if high else max(low)] if not low else marks[max(low)]
        else:
            a, b = max(low), min(high)
            c = [p + (q - p) * ((t - a) / (b - a)) for p, q in zip(marks[a], marks[b])]
        return math.floor(c[0] - 40 + 0.5), math.floor(c[1] - 10 + 0.5), 80, 20

    expected = {(ids["phone"], t): place(t) for t in times} | {(ids["email"], t): (800, 0, 80, 20) for t in times}
    order = ["time_ms", "cand_ord"]
    for keys in (linked, linked.drop("prior")):
        found = rg.box_at_time(asked, keys, order, chunk).collect()
        assert len(found) == len(expected) and {(r.event_id, r.at_ms): tuple(r.bbox) for r in found} == expected
    text = rg.box_at_time(asked, linked, order, chunk)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [") == 2


def test_keyframes_meet_edits_once(spark):
    """Edits replace, add and repeat; equal times and other columns stay, and keyframes are shuffled once."""
    keys = spark.createDataFrame([
        ("v", "a", 1, 5, 1, 1, 9, 9, "p"), ("v", "a", 1, 6, 2, 2, 9, 9, "q"), ("v", "a", 3, 7, 3, None, 9, 9, "r"), ("v", "b", 1, 8, 4, 4, 9, 9, None),
    ], "video_id string, event_id string, time_ms long, cand_ord long, x int, y int, w int, h int, note string")
    edits = spark.createDataFrame([
        ("v", "a", 1, 1, 50, 50, 7, 7), ("v", "a", 1, 2, 60, 60, 7, 7), ("v", "a", 2, 1, 70, 70, 7, 7), ("v", "c", 1, 1, 80, 80, 7, 7),
    ], "video_id string, event_id string, time_ms long, edit_seq int, x int, y int, w int, h int")
    done = rg.upsert_keyframes(keys, edits)
    text = done._jdf.queryExecution().executedPlan().toString()
    assert done.dtypes == keys.dtypes and text.count("Join") == 1
    assert sorted((tuple(r) for r in done.collect()), key=str) == sorted([
        ("v", "a", 1, 5, 60, 60, 7, 7, "p"), ("v", "a", 1, 6, 60, 60, 7, 7, "q"), ("v", "a", 3, 7, 3, None, 9, 9, "r"),
        ("v", "b", 1, 8, 4, 4, 9, 9, None), ("v", "a", 2, None, 70, 70, 7, 7, None), ("v", "c", 1, None, 80, 80, 7, 7, None),
    ], key=str)
