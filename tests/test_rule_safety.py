"""Rules that reuse ids, patterns that Java reads otherwise, holes in the frames and repeated decisions."""

import pytest
from veilmark.operators.classify import regex_candidates
from veilmark.operators.redact import redact_text
from veilmark.operators.review import set_statuses
from veilmark.operators.sampling import adaptive_sample
from veilmark.operators.settings import patch_settings
from veilmark.sources.rules import builtin_rules, make_rule, pattern_problem, read_rules, rule_errors, to_java


def test_a_reused_id_has_no_guard(spark, make_boxes):
    rule = make_rule("email", "mailto", "custom")
    boxes = make_boxes([(0, "contact emp 12 mailto", (0, 0, 10, 10))])
    assert regex_candidates(boxes, [rule]).count() == 1
    masked = redact_text(boxes.select("text"), "text", [rule]).first()
    assert masked["redacted"] == "contact emp 12 " + "█" * 6


def test_a_patched_builtin_has_no_guard(spark, make_boxes):
    rules = [{**r, "pattern": "badge"} if r["rule_id"] == "ssn" else r for r in builtin_rules() if r["type"] == "regex"]
    assert regex_candidates(make_boxes([(0, "my badge", (0, 0, 10, 10))]), rules).count() == 1


@pytest.mark.parametrize("pattern, text", [
    (r"(?P<emp_id>emp) \d+", "emp 12"), ("[[]x", "[x"), ("[]]x", "]x"), ("[^]]x", "yx"), ("[a&&b]x", "&x"), (r"[\]a]x", "]x"),
])
def test_python_patterns_run(spark, make_boxes, pattern, text):
    assert pattern_problem(pattern) is None
    found = regex_candidates(make_boxes([(0, text, (0, 0, 10, 10))]), [make_rule("r", pattern, "custom")])
    assert [r["text"] for r in found.collect()] == [text]


@pytest.mark.parametrize("pattern", ["(a+)+", "(?:a|b*)*", "(a{2,})+", "[a", "(?<=a+)b", None, "a" * 501])
def test_bad_patterns_are_skipped_and_reported(spark, make_boxes, pattern):
    rules = [make_rule("bad", pattern, "custom"), make_rule("good", "x", "custom", rule_ord=1)]
    assert [r["rule_id"] for r in rule_errors(spark, rules).collect()] == ["bad"]
    assert regex_candidates(make_boxes([(0, "x", (0, 0, 10, 10))]), rules).count() == 1


def test_builtin_patterns_stay_as_they_are(spark):
    for rule in builtin_rules():
        assert pattern_problem(rule["pattern"]) is None
        assert to_java(rule["pattern"]) == rule["pattern"]


def test_many_rule_files_are_numbered_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"r{k}.json").write_text(f'[{{"rule_id": "c{k}a", "name": "n", "type": "regex"}}, {{"rule_id": "c{k}b", "name": "n", "type": "regex"}}]')
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        rows = read_rules(spark, str(tmp_path)).orderBy("rule_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["rule_id"] for r in rows[-6:]] == ["c0a", "c0b", "c1a", "c1b", "c2a", "c2b"]
    assert [r["rule_ord"] for r in rows] == list(range(len(rows)))


def test_more_than_two_thousand_rules(spark):
    from veilmark.sources.rules import collect_rules, rules_frame

    assert len(collect_rules(rules_frame(spark, [make_rule(f"r{i}", "x", rule_ord=i) for i in range(2500)]))) == 2500


def test_a_missing_frame_is_passed_over(spark):
    rows = [("v", i, [1.0, 0.0]) for i in range(40) if i != 12]
    frames = spark.createDataFrame(rows, "video_id string, frame_idx long, hist array<double>")
    for width in (8, 4096):
        got = sorted(r["frame_idx"] for r in adaptive_sample(frames, 3, chunk_frames=width).collect())
        assert got == [i for i in range(0, 40, 3) if i != 12]


def test_the_last_decision_counts(spark):
    events = spark.createDataFrame([("p", 1, "pending")], "project_id string, event_id long, status string")
    updates = spark.createDataFrame(
        [("p", 1, "rejected", 1), ("p", 1, "accepted", 2)], "project_id string, event_id long, new_status string, seq int")
    assert set_statuses(events, updates).first()["status"] == "accepted"


def test_two_patches_make_one_row(spark):
    base = spark.createDataFrame([("p", 1)], "project_id string, a int")
    patches = spark.createDataFrame([("p", ["a"], 2, 1), ("p", ["a"], 3, 2)], "project_id string, given array<string>, a int, seq int")
    assert [r["a"] for r in patch_settings(base, patches, ["a"]).collect()] == [3]


def test_control_characters_are_no_blanks(spark):
    df = spark.createDataFrame([("a\x01b",)], "text string")
    assert redact_text(df, "text", [make_rule("r", r"a\sb", "custom")]).first()["n_spans"] == 0


def test_one_bad_file_leaves_the_others(spark, tmp_path):
    from veilmark.sources.rules import rule_file_errors

    good = '[{"rule_id": "g", "name": "G", "type": "regex", "pattern": "x"}]'
    (tmp_path / "a.json").write_text(good)
    (tmp_path / "b.json").write_text('[{"rule_id": "h", "name": "H", "type": "regex", "pattern": "y"}, {"rule_id": "i", "name": "I", "type": "odd"}]')
    (tmp_path / "c.json").write_text("{ not json")
    (tmp_path / "d.json").write_text(good.replace('"g"', '"k"'))
    rows = read_rules(spark, str(tmp_path)).orderBy("rule_ord").collect()
    assert [(r["rule_id"], r["rule_ord"]) for r in rows[14:]] == [("g", 14), ("k", 15)]
    found = {r["file"][-6:]: r["problem"] for r in rule_file_errors(spark, str(tmp_path)).collect()}
    assert found == {"b.json": "unknown type", "c.json": "not JSON of a rule"}


def test_presets_of_several_files_are_numbered(spark, tmp_path):
    from veilmark.sources.presets import BUILTIN, read_presets

    for name in "ab":
        (tmp_path / f"{name}.json").write_text(f'[{{"preset_id": "{name}1", "name": "x"}}, {{"preset_id": "{name}2", "name": "x"}}]')
    rows = read_presets(spark, custom_path=str(tmp_path)).where("NOT builtin").orderBy("preset_ord").collect()
    assert [(r["preset_id"], r["preset_ord"] - len(BUILTIN)) for r in rows] == [("a1", 0), ("a2", 1), ("b1", 2), ("b2", 3)]
    built = read_presets(spark, [str(tmp_path / "b.json"), str(tmp_path / "a.json")]).orderBy("preset_ord").collect()
    assert [r["preset_id"] for r in built] == ["a1", "a2", "b1", "b2"]
