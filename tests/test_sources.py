"""Readers, writers and reports on small files."""

import json

from pyspark.sql import functions as F

from veilmark.operators.jobs import audit_events, audit_summary
from veilmark.sources import boxes, event_store, media, presets, projects, reports


def project(i, **extra):
    doc = {
        "project_id": f"p{i}", "name": f"Case {i}", "created_at": "2024-01-01T00:00:00Z",
        "updated_at": f"2024-01-0{i}T00:00:00Z", "video": None, "scan_settings": {"secure_mode": False},
        "output_settings": {"use_hw_encoder": True, "use_nvenc": False},
        "events": [{
            "event_id": "e", "pii_type": "phone", "confidence": 0.5, "status": "accepted",
            "time_ranges": [{"start_ms": 1, "end_ms": 2}],
            "keyframes": [{"time_ms": 1, "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}],
        }],
    }
    return {**doc, **extra}


def test_projects(spark, tmp_path):
    for i in (1, 2):
        folder = tmp_path / f"p{i}"
        folder.mkdir()
        (folder / "project.json").write_text(json.dumps(project(i), indent=2))
    broken = tmp_path / "p3"
    broken.mkdir()
    (broken / "project.json").write_text("{ nope")
    good, bad = projects.read_projects(spark, f"{tmp_path}/*/project.json")
    assert [r.project_id for r in projects.list_projects(good).collect()] == ["p2", "p1"]
    assert bad.count() == 1
    assert {r.output_settings.use_hw_encoder for r in good.collect()} == {False}
    events = projects.project_events(good)
    assert projects.event_keyframes(events).first().w == 3
    assert projects.event_ranges(events).first().end_ms == 2
    out = tmp_path / "saved"
    projects.write_projects(good, str(out))
    again = spark.read.json(str(out))
    assert again.filter(F.col("updated_at") > "2024-02").count() == 2


def test_presets(spark, tmp_path):
    assert [r.preset_id for r in presets.read_presets(spark).orderBy("preset_ord").collect()][0] == "customer_support_chat"
    for name in ("b", "a"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"preset_id": name, "name": name, "scan_settings": {"confidence_threshold": 0.1}}))
    custom = tmp_path / "custom.json"
    custom.write_text(json.dumps([{"preset_id": "mine", "name": "m"}]))
    rows = presets.read_presets(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], str(custom)).collect()
    assert {(r.preset_id, r.builtin) for r in rows} == {("a", True), ("b", True), ("mine", False)}


def test_files(spark, tmp_path):
    for name in ("a.MP4", "b.txt", "c.webm"):
        (tmp_path / name).write_bytes(name.encode())
    listed = media.file_inventory(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in listed) == ["a.MP4", "c.webm"]
    prints = media.file_fingerprints(spark, str(tmp_path))
    assert prints.filter(F.length("file_hash") == 64).count() == 3
    changed = media.changed_files(prints, prints.filter(F.col("path").endswith("b.txt")))
    assert changed.filter("changed").count() == 2


def test_probe_defaults(spark):
    docs = spark.createDataFrame([
        (1, '{"streams":[{"codec_type":"audio"}],"format":{}}'),
        (2, '{"streams":[{"codec_type":"video"}],"format":{}}'),
        (3, '{"streams":[{"codec_type":"video","r_frame_rate":"30000/1001","width":10,"height":20,"codec_name":"h265"}],'
            '"format":{"duration":"1.2345","format_name":"mov"}}'),
    ], "id int, probe string")
    rows = {r.id: r for r in media.probe_metadata(docs).collect()}
    assert set(rows) == {2, 3} and media.without_video(docs).count() == 1
    assert (rows[2].fps, rows[2].duration_ms, rows[2].codec, rows[2].width) == (30.0, 0, "unknown", 0)
    assert rows[3].duration_ms == 1234 and abs(rows[3].fps - 29.97) < 0.001


def test_boxes_layout(spark, make_boxes, tmp_path):
    frame = make_boxes([(i, f"t{i}", (0, 0, 1, 1)) for i in range(50)])
    boxes.write_boxes(frame, str(tmp_path / "b"), 4)
    back = boxes.read_boxes(spark, str(tmp_path / "b"))
    assert back.count() == 50 and back.filter("video_id = 'v' AND frame_idx BETWEEN 3 AND 5").count() == 3
    plan = back.filter("frame_idx > 3").select("text")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(frame_idx), GreaterThan(frame_idx,3)]" in plan


def report_input(spark):
    style = "struct<type:string,strength:int,color:string>"
    events = spark.createDataFrame([
        ("p", 1, "accepted", "phone", 0.5, "<b>", 0, 5, "csrt", ("blur", 1, "#0")),
        ("p", 2, "accepted", "email", 0.25, None, 3, 9, "none", ("blur", 1, "#0")),
        ("p", 3, "rejected", "email", 0.25, "x", 3, 9, "none", ("blur", 1, "#0")),
    ], "project_id string, event_id long, status string, pii_type string, confidence double, extracted_text string,"
       f"start_ms int, end_ms int, tracking_method string, style {style}")
    head = audit_summary(events, ["project_id"]).withColumns({
        "project_name": F.lit("A & B"), "path": F.lit(None).cast("string"), "duration_ms": F.lit(None).cast("int"),
    })
    return head, audit_events(events)


def test_json_report_is_one_document(spark, tmp_path):
    lines = reports.json_report(*report_input(spark), F.lit("now"))
    reports.write_report(lines, str(tmp_path / "r"))
    text = "".join(
        p.read_text() for p in sorted((tmp_path / "r" / "project_id=p").glob("part-*"))
    )
    doc = json.loads(text)
    assert doc["summary"] == {"total_events": 3, "accepted": 2, "rejected": 1, "pending": 0}
    assert doc["video"] == {"path": None, "duration_ms": None}
    assert [e["event_id"] for e in doc["redacted_events"]] == ["1", "2"]
    assert doc["redacted_events"][1]["extracted_text"] is None
    assert doc["redacted_events"][0]["time_ranges"] == [{"start_ms": 0, "end_ms": 5}]


def test_html_report_escapes(spark):
    lines = [r.line for r in reports.html_report(*report_input(spark), F.lit("now")).orderBy("section", "event_id").collect()]
    page = "".join(lines)
    assert "&lt;b&gt;" in page and "A &amp; B" in page and "[redacted]" in page and "0ms–5ms" in page and "50%" in page
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>")


def test_reports_of_many_projects_fill_the_buckets_only(spark, tmp_path):
    head, audit = report_input(spark)
    many = head.join(spark.range(2000).select(F.concat(F.lit("p"), "id").alias("_p"))).withColumn("project_id", F.col("_p")).drop("_p")
    lines = reports.html_report(many, audit, F.lit("now"))
    reports.save_reports(lines, str(tmp_path / "r"), 8)
    files = list((tmp_path / "r").rglob("part-*"))
    assert 8 <= len(files) <= 16
    back = reports.open_reports(spark, str(tmp_path / "r"))
    assert sorted(map(str, back.collect())) == sorted(map(str, lines.select(back.columns).collect()))
    some = reports.open_reports(spark, str(tmp_path / "r"), ["p7", "p1999"])
    assert {r.project_id for r in some.collect()} == {"p7", "p1999"}
    assert len(some.inputFiles()) <= len(files) and "PartitionFilters: [" in some._jdf.queryExecution().toString()
    one = reports.open_reports(spark, str(tmp_path / "r"), ["p7"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in one.split("PartitionFilters: [")[1].split("]")[0]


def stored(spark, events, keyframes):
    kinds = "project_id string, event_id string, status string, start_ms long, end_ms long"
    return (
        spark.createDataFrame(events, kinds),
        spark.createDataFrame(keyframes, "project_id string, event_id string, time_ms long, x int, y int, w int, h int"),
    )


def test_events_are_saved_in_bounded_parts_and_reopened(spark, tmp_path):
    """A long event spans many lines; one without keyframes, orphans, repeats and null ids stay."""
    events = [("p", "long", "accepted", 0, 10**10), ("p", "bare", None, 5, 5), ("q", "twice", "pending", 1, 2)] + [("q", "twice", "pending", 1, 2), (None, None, "pending", 3, 3)]
    marks = [("p", "long", 10 * i, i, 1, 2, 3) for i in range(95)] + [("q", "orphan", 7, 0, 0, 1, 1)] * 2 + [(None, None, 3, 0, 0, 1, 1)]
    tables = stored(spark, events, marks)
    lines = event_store.event_lines(*tables, part_keyframes=10, chunk_ms=100)
    assert lines.agg(F.max(F.size("keyframes"))).first()[0] == 10
    event_store.save_events(*tables, str(tmp_path / "e"), part_keyframes=10, buckets=4, chunk_ms=100)
    back, keyframes = event_store.open_events(spark, str(tmp_path / "e"))
    assert sorted(map(str, ((r.project_id, r.event_id, r.status, r.time_ranges[0].start_ms, r.time_ranges[0].end_ms) for r in back.collect()))) == sorted(map(str, events))
    rows = keyframes.collect()
    assert sorted(map(str, ((r.project_id, r.event_id, r.time_ms, r.x, r.y, r.w, r.h) for r in rows))) == sorted(map(str, marks))
    assert [r.kf_ord for r in sorted((r for r in rows if r.event_id == "long"), key=lambda r: r.time_ms)] == list(range(95))
    only, _ = event_store.open_events(spark, str(tmp_path / "e"), ids=["q"])
    assert {r.event_id for r in only.collect()} == {"twice"} and only.count() == 2


def test_no_events_are_saved_and_reopened(spark, tmp_path):
    event_store.save_events(*stored(spark, [], []), str(tmp_path / "e"))
    back, keyframes = event_store.open_events(spark, str(tmp_path / "e"))
    assert back.count() == 0 and keyframes.count() == 0


def test_saved_events_are_compressed(spark, tmp_path):
    """Ids and field names repeat in each line; files of text shrink to a fraction and come back whole."""
    rows = spark.range(4000).selectExpr("'p' AS project_id", "concat('event-', id % 7) AS event_id", "id AS time_ms", "named_struct('x', 1, 'y', 2, 'w', 3, 'h', 4) AS bbox")
    heads = rows.select("project_id", "event_id").distinct().selectExpr("*", "'phone' AS pii_type", "0L AS start_ms", "9L AS end_ms")
    event_store.save_events(heads, rows, str(tmp_path / "e"), part_keyframes=10, buckets=4)
    files = [f for f in (tmp_path / "e").rglob("part-*") if f.is_file()]
    assert files and all(f.name.endswith(".json.gz") for f in files) and sum(f.stat().st_size for f in files) < 60_000
    events, keyframes = event_store.open_events(spark, str(tmp_path / "e"))
    assert events.count() == 7 and keyframes.select("event_id", "kf_ord", "time_ms").distinct().count() == 4000
