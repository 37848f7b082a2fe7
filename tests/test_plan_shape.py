"""What the physical plans of the central queries look like."""

import re

import pytest

from veilmark.catalog.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["regex_rule_hits", "redact_solid", "html_rule_hits", "box_filter", "batch_pct"])
def test_narrow_queries_do_not_shuffle(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_only_needed_columns_are_read(spark, sf):
    text = plan(QUERIES["redact_solid"](spark, sf))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan(QUERIES["regex_rule_hits"](spark, sf))


def test_undo_keeps_few_rows_before_the_shuffle(spark, sf):
    text = plan(QUERIES["undo_stack"](spark, sf))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["findings_groups", "audit_summary", "replay_log", "regex_rule_counts"])
def test_counts_are_combined_before_the_shuffle(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "partial_count" in text and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["findings_groups", "audit_json", "audit_html", "scan_preview", "link_summary"])
def test_groups_are_not_collected(spark, sf, name):
    assert "collect_list" not in plan(QUERIES[name](spark, sf))


def test_labels_meet_values_on_cells(spark, sf):
    text = plan(QUERIES["label_rule_below"](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["merge_regions", "merge_with_polygons"])
def test_filled_frames_are_not_moved(spark, sf, name):
    """Gaps are put together before they are filled: no shuffle above the frames."""
    text = plan(QUERIES[name](spark, sf))
    above = text[:text.index("Generate explode(sequence(")]
    assert "MapInArrow" in above and "Exchange" not in above and "Aggregate" not in above


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "batch_item", "progress_log"))))
def test_no_cross_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["merge_tracks", "interpolated_boxes", "keyframe_pairs", "lerp_boxes", "close_unions"])
def test_gaps_need_no_windows(spark, sf, name):
    """The keyframe before comes from the walk."""
    assert "Window" not in plan(QUERIES[name](spark, sf))
