"""The training-data queries that SQL can express, against it, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

pytest.importorskip("public_tokenizers")

from check_oracle import canonical, duck  # noqa: E402

from veilmark.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rel = duck(sf).execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(rel.fetchall(), columns)
