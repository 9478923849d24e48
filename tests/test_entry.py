"""The driver's contract."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_entry(spark):
    found = entry.entry(spark)
    assert found.count() == 10 and found.columns == ["vec_id", "distance", "score", "rank"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100
