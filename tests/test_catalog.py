"""Every query against its SQL over a whole small folder."""

from __future__ import annotations

import os

import pytest
from oracle import connection, differs

from chronoply.operators import attention
from chronoply.plans import catalog

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, con, name):
    assert not differs(spark, con, catalog.queries()[name], SQL[name], SF)


def test_queries_without_sql(spark):
    for name in sorted(set(catalog.queries()) - set(SQL)):
        assert catalog.queries()[name](spark, SF).count() >= 0


def test_long_cases_are_padded_whole(spark, tmp_path):
    spark.range(130).selectExpr("id AS event_id", "IF(id < 120, 1L, 2L) AS user_id", "'click' AS event_type", "timestamp_micros(id) AS ts", "1D AS value", "'{\"k\": 2}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in catalog.queries()["pad_and_mask"](spark, str(tmp_path)).collect())
    assert got == [(1, 120, 0, 240), (2, 10, 110, 20)]


def test_heatmap_of_all_positions(spark):
    """Positions beyond 5 too, each with the mean over the ranks it occurs in."""
    rows = [(0, 1, 7, 0.9), (0, 1, 90, 0.5), (0, 2, 7, 0.4), (0, 3, 2, 0.1)]
    got = {(r.bin, r.pos): round(r.mean_importance, 6) for r in attention.heatmap_long(spark.createDataFrame(rows, "bin int, rank int, pos long, imp double")).collect()}
    assert got == {(0, 7): 0.6, (0, 90): 0.7, (0, 2): 0.1}
    assert "importance_heatmap_long" in SQL
