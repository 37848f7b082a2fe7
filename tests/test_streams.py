"""Streams in several batches give what the batch operators give."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilmark.operators.link import event_summary, link_candidates
from veilmark.operators.sampling import scene_changes
from veilmark.sources import adapters as ad
from veilmark.streaming import progress as pg
from veilmark.streaming import stateful, stateless


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """Candidates of the event log as five files in time order, with a far-future row to close all."""
    folder = tmp_path_factory.mktemp("parts")
    rows = ad.cands(spark, sf).withColumn("at", F.timestamp_millis("time_ms")).orderBy("time_ms").collect()
    schema = ad.cands(spark, sf).withColumn("at", F.timestamp_millis("time_ms")).schema
    size = len(rows) // 5 + 1
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    end = rows[-1].asDict() | {"video_id": "end", "time_ms": rows[-1].time_ms + 10**10}
    end["at"] = end["at"].replace(year=end["at"].year + 1)
    spark.createDataFrame([end], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def opened(spark, folder):
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_link_equals_batch(spark, sf, parts):
    done = stateless.run_to_table(stateful.stream_link(opened(spark, parts), "at", 86_400_000, 400))
    batch = event_summary(link_candidates(ad.cands(spark, sf), gap_ms=86_400_000, tolerance_px=400))
    key = ["video_id", "pii_type", "seed_ms", "seed_ord", "end_ms", "n_keyframes"]
    # The sentinel's own event is no part of the comparison.
    found = done.filter("video_id <> 'end'")
    assert sorted(found.select(key).collect()) == sorted(batch.select(key).collect())


def test_shuffled_batches_link_like_the_batch(spark, tmp_path):
    """Rows of each file belong anywhere within the lateness; cuts split events."""
    rng = random.Random(6)
    schema = "video_id string, pii_type string, time_ms long, cand_ord long, confidence double, x int, y int, w int, h int, text string, last_cut_ms long"
    rows = [("v%d" % (i % 3), "phone", 700 * i, i, 0.5, rng.randrange(300), 0, 80, 20, "t", 700 * i // 40_000 * 40_000) for i in range(100, 400)]
    order = sorted(rows, key=lambda r: r[2] + rng.randrange(50_000)) + [("end", "phone", 10**9, 999, 0.5, 0, 0, 80, 20, "t", None)]
    for i in range(0, len(order), 60):
        part = spark.createDataFrame(order[i:i + 60], schema).withColumn("at", F.timestamp_millis("time_ms"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path))
    done = stateless.run_to_table(stateful.stream_link(opened(spark, str(tmp_path)), "at", 6000, 150, "60 seconds"))
    cuts = spark.createDataFrame([(v, t) for v in ("v0", "v1", "v2") for t in range(40_000, 300_000, 40_000)], "video_id string, cut_ms long")
    batch = event_summary(link_candidates(spark.createDataFrame(rows, schema).drop("last_cut_ms"), cuts, gap_ms=6000, tolerance_px=150))
    key = ["video_id", "seed_ms", "seed_ord", "end_ms", "n_keyframes"]
    assert sorted(done.filter("video_id <> 'end'").select(key).collect()) == sorted(batch.select(key).collect())


class _Values:
    """State of one key in memory that counts what is read."""

    def __init__(self):
        self.kept, self.reads = {}, 0

    def getValueState(self, name, schema):
        return _One()

    def getMapState(self, name, key_schema, schema):
        return self

    def registerTimer(self, at):
        self.due = at

    def getValue(self, key):
        self.reads += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.kept[key] = value

    def removeKey(self, key):
        del self.kept[key]


class _One:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_timer_reads_what_it_releases():
    """Of 500 waiting buckets a timer reads the pieces that are due, and the rest stay as they lie."""
    handle, link = _Values(), stateful._Linker(1000, 50)
    link.init(handle)
    for batch in range(2):
        rows = pd.DataFrame({"time_ms": [1000 * i + batch for i in range(500)], "cand_ord": [2 * i + batch for i in range(500)],
                             "x": 0, "y": 0, "w": 1, "h": 1, "confidence": 0.5})
        assert list(link.handleInputRows(("v", "phone"), iter([rows]), None)) == []
    assert len(handle.kept) == 1000 and handle.reads == 0 and handle.due == 0
    list(link.handleExpiredTimer(("v", "phone"), _Clock(3000), None))
    # Buckets 0 to 3 were due; the last row of bucket 3 is written back.
    assert handle.reads == 8 and len(handle.kept) == 993 and handle.kept[3, 0][0][0][0] == 3001
    assert handle.due == 3001
    out = pd.concat(list(link.handleExpiredTimer(("v", "phone"), _Clock(10**6), None)))
    assert handle.kept == {} and list(out["n_keyframes"]) == [1000] and list(out["end_ms"]) == [499_001]


def test_few_waiting_rows_cost_one_write(spark, tmp_path):
    """Few rows lie with the open events; the many that follow them go to buckets, and all link in order of time."""
    handle, link = _Values(), stateful._Linker(1000, 50)
    link.init(handle)
    batch = lambda times, first: pd.DataFrame({"time_ms": times, "cand_ord": range(first, first + len(times)), "x": 0, "y": 0, "w": 1, "h": 1, "confidence": 0.5})
    list(link.handleInputRows(("v", "phone"), iter([batch([90_000, 500, 30_500], 0)]), None))
    assert handle.kept == {} and handle.due == 500
    list(link.handleInputRows(("v", "phone"), iter([batch(list(range(1000, 90_000, 500)), 3)]), None))
    assert len(handle.kept) == 91 and handle.reads == 0
    list(link.handleInputRows(("v", "phone"), iter([batch([89_900, 200], 500)]), None))
    assert len(handle.kept) == 91 and handle.due == 200
    out = [e for now in (3000, 50_000, 10**6) for f in link.handleExpiredTimer(("v", "phone"), _Clock(now), None) for e in f.itertuples(index=False)]
    assert handle.kept == {} and [(e.start_ms, e.end_ms, e.n_keyframes) for e in out] == [(200, 90_000, 183)]


def test_candidates_at_and_before_1970_are_not_late(spark, tmp_path):
    schema = "video_id string, pii_type string, time_ms long, cand_ord long, confidence double, x int, y int, w int, h int, text string"
    rows = [("v", "phone", t, i, 0.5, 0, 0, 80, 20, "t") for i, t in enumerate([-1500, -1000, 0, 10**7])]
    part = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("time_ms"))
    part.coalesce(1).write.mode("append").parquet(str(tmp_path))
    found = stateless.run_to_table(stateful.stream_link(opened(spark, str(tmp_path)), "at", 2000, 50, "10 seconds")).collect()
    assert [(r.start_ms, r.end_ms, r.n_keyframes) for r in found] == [(-1500, 0, 3)]


def test_dedupe_across_batches(spark, parts):
    once = stateless.dedupe_stream(opened(spark, parts), "at", ["video_id", "pii_type"], "900 days")
    assert stateless.run_to_table(once).count() == spark.read.parquet(parts).select("video_id", "pii_type").distinct().count()


def test_scene_state_across_batches(spark, sf, tmp_path):
    rows = ad.hists(spark, sf).orderBy("frame_idx").collect()
    for i in range(0, len(rows), len(rows) // 3 + 1):
        spark.createDataFrame(rows[i:i + len(rows) // 3 + 1], ad.hists(spark, sf).schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = opened(spark, str(tmp_path))
    found = stateless.run_to_table(stateful.stream_scene_changes(stream, 0.4))
    batch = scene_changes(ad.hists(spark, sf), 0.4)
    key = ["video_id", "prev_frame", "frame_idx"]
    assert sorted(found.select(key).collect()) == sorted(batch.select(key).collect())


def test_shuffled_frames_give_the_scenes_of_the_batch(spark, sf, tmp_path):
    """Frames come anywhere within the lateness; an idle video is forgotten."""
    rng = random.Random(2)
    hists = ad.hists(spark, sf)
    rows = [(r.video_id, r.frame_idx, r.hist) for r in hists.collect()]
    schema = "video_id string, frame_idx int, hist array<double>"
    end = max(r[1] for r in rows)
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(25)) + [("zz", end + 5000, [1.0]), ("zz", end + 9000, [1.0])]
    for i in range(0, len(order), len(order) // 4 + 1):
        part = spark.createDataFrame(order[i:i + len(order) // 4 + 1], schema).withColumn("at", F.timestamp_millis(F.col("frame_idx").cast("long") * 1000))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path))
    key = ["video_id", "prev_frame", "frame_idx"]
    found = stateless.run_to_table(stateful.stream_timed_scene_changes(opened(spark, str(tmp_path)), "at", 0.4, "30 seconds", 1 << 40))
    assert sorted(found.select(key).collect()) == sorted(scene_changes(hists, 0.4).select(key).collect())
    idle = stateless.run_to_table(stateful.stream_timed_scene_changes(opened(spark, str(tmp_path)), "at", 0.4, "30 seconds", 2000))
    near = [r for r in scene_changes(hists, 0.4).select(key).collect() if r.frame_idx - r.prev_frame <= 2]
    assert sorted(idle.select(key).collect()) == sorted(near)


def test_frames_at_and_before_1970_are_not_late(spark, tmp_path):
    """The first watermark stands at 1970; frames up to it count like others."""
    rows = [("v", i, [float(i % 2), float(1 - i % 2)]) for i in range(-3, 40)]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx int, hist array<double>")
    frames.withColumn("at", F.timestamp_millis(F.col("frame_idx").cast("long") * 1000)).coalesce(1).write.mode("append").parquet(str(tmp_path))
    found = stateless.run_to_table(stateful.stream_timed_scene_changes(opened(spark, str(tmp_path)), "at", 0.4, "10 seconds", 1 << 40))
    assert sorted(r.prev_frame for r in found.collect()) == list(range(-3, 29))


def test_progress_fold(spark):
    schema = "scan_id string, seq long, stage string, progress_pct int, findings int, message string"
    rows = [
        ("a", 0, "ocr", 77, 9, None), ("a", 1, "starting", None, None, None), ("a", 2, "ocr", 40, 3, None),
        ("a", 3, "warning", None, None, "careful"), ("a", 4, "linking", None, None, None),
        ("b", 0, "starting", None, None, None), ("b", 1, "done", None, None, None), ("c", 0, "warming_up", None, None, None),
        ("d", 0, "starting", None, None, None), ("d", 1, "warning", None, None, "w"), ("d", 2, "starting", None, None, None),
    ]
    state = {r.scan_id: tuple(r)[1:] for r in pg.progress_state(spark.createDataFrame(rows, schema)).collect()}
    assert state["a"] == ("linking", 40, 3, True, "careful")
    assert state["b"] == ("done", 100, 0, False, None)
    assert state["c"] == ("warming_up", 0, 0, False, None)
    assert state["d"] == ("starting", 0, 0, True, None)


def test_batch_item_fold(spark):
    schema = "batch_id string, seq long, item_idx int, stage string, pct int, events_found int, error string"
    rows = [
        ("b", 0, 0, "video_start", None, None, None), ("b", 1, 0, "video_imported", None, None, None),
        ("b", 2, 0, "ocr", 30, None, None), ("b", 3, 0, "scan_done", None, 4, None),
        ("b", 4, 0, "export_progress", 50, None, None), ("b", 5, 0, "video_done", None, None, None),
        ("b", 6, 1, "video_start", None, None, None), ("b", 7, 1, "video_error", None, None, "bad file"),
        ("b", 8, 2, "scan_done", None, None, None),
    ]
    state = {r.item_idx: tuple(r)[2:] for r in pg.batch_item_state(spark.createDataFrame(rows, schema)).collect()}
    assert state == {0: ("done", 100, 100, 4, None), 1: ("error", 0, 0, 0, "bad file"), 2: ("queued", 100, 0, 0, None)}
