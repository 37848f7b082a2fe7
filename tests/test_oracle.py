"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import canonical, duck  # noqa: E402

from veilmark.catalog.registry import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark, sf):
    assert entry.entry(spark).columns == ["video_id", "pii_type", "rule_id", "findings"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(rel.fetchall(), columns)
