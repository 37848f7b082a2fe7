"""Lists of terms as tables against plain search."""

import random
import time

import pytest

from veilmark.functions.rolling import Rolling
from veilmark.operators import terms
from veilmark.operators.classify import deny_list
from veilmark.sources.rules import make_rule

RULES = "rule_ord long, rule_id string, type string, enabled boolean, pattern string, label string, confidence double"


def test_windows_hash_alike_wherever_they_stand():
    import numpy as np

    data = np.frombuffer(b"xxabcabcab\xc3\xa9", np.uint8)
    sums = Rolling(data)
    assert sums.windows(np.array([2]), 3) == sums.windows(np.array([5]), 3) == Rolling(data[2:5]).windows(np.array([0]), 3)
    assert sums.windows(np.array([2]), 3) != sums.windows(np.array([2]), 4)


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_listed_terms_equal_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(terms, "BLOCK_BYTES", block)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("aAbBé日 ") for _ in range(rng.randrange(1, n)))
    texts = [(i, word(60)) for i in range(150)] + [(200, None), (201, ""), (202, "needle " * 3000), (202, "needle " * 3000), (203, "a" * 500)]
    listed = [(i, word(6)) for i in range(60)] + [(90, None), (91, ""), (92, "NEEDLE needle"), (93, "a" * 300), (93, "a" * 300), (94, word(60)), (95, "b")]
    left = spark.createDataFrame([(*t, 1) for t in texts], "row int, text string, term int").repartition(3)
    right = spark.createDataFrame([(*t, "x") for t in listed], "row int, pattern string, whole string")
    got = terms.listed_terms(left, right).selectExpr("row.row AS a", "term.row AS b").collect()
    want = [(a, b) for a, t in texts for b, p in listed if t and p and p.lower() in t.lower()]
    assert sorted(map(tuple, got)) == sorted(want)
    assert terms.listed_terms(left, right.limit(0)).count() == 0 and terms.listed_terms(left.limit(0), right).count() == 0


def test_table_gives_the_rows_of_the_list(spark, make_boxes):
    boxes = make_boxes([(0, "Acme Corp and friends", (0, 0, 9, 9)), (1, "nobody", (0, 0, 9, 9)), (2, "ACME CORP, acme corp", (1, 1, 9, 9))])
    rules = [make_rule("acme", "acme corp", "phone", type="denylist", rule_ord=1, priority=1), make_rule("x", "friend", "odd", type="denylist", rule_ord=2, priority=1)]
    table = spark.createDataFrame([
        (r["rule_ord"], r["rule_id"], r["type"], True, r["pattern"], r["label"], float(r["confidence"])) for r in rules
    ] + [(3, "off", "denylist", False, "nobody", "phone", 0.5), (4, "other", "regex", True, "nobody", "phone", 0.5)], RULES)
    assert sorted(map(str, terms.deny_list_table(boxes, table).collect())) == sorted(map(str, deny_list(boxes, rules).collect()))


def test_spared_texts(spark):
    found = spark.createDataFrame([("v", 1, "Keep"), ("v", 2, "DROP"), ("v", 3, None)], "video_id string, frame_idx int, text string")
    table = spark.createDataFrame([(1, "a", "allowlist", True, "drop", "", 1.0), (2, "b", "allowlist", False, "keep", "", 1.0), (3, "c", "allowlist", True, None, "", 1.0)], RULES)
    assert sorted(r.frame_idx for r in terms.spared_by_table(found, table).collect()) == [1, 3]


def test_a_million_terms(spark, sf):
    """The plan is that of a few terms, and a long list takes seconds."""
    boxes = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("source AS video_id", "CAST(doc_id AS INT) frame_idx", "0 AS box_ord", "text", "named_struct('x', 0, 'y', 0, 'w', 1, 'h', 1) AS bbox")
    plans = []
    for n in (1000, 1_000_000):
        rules = spark.range(n).selectExpr(
            "id AS rule_ord", "concat('r', id) AS rule_id", "'denylist' AS type", "true AS enabled",
            "CASE WHEN id = 0 THEN 'the' ELSE concat('zq', id, 'person ', id % 9973) END AS pattern", "'' AS label", "0.5D AS confidence")
        start = time.perf_counter()
        found = terms.deny_list_table(boxes, rules)
        rows = found.groupBy("rule_id").count().collect()
        took = time.perf_counter() - start
        assert [r.rule_id for r in rows] == ["r0"]
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1] and took < 60
