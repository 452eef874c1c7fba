"""Every registered query against its DuckDB twin at sf0.001 (the driver does the same at sf0.01)."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from yieldnorm.operators import model
from yieldnorm.plans import queries as registry

from .conftest import SF0001

TABLES = "region nation customer supplier part orders lineitem".split()
# the training-data operators have tests of their own
QUERIES = {n: q for n, q in entry.queries().items() if n in registry.QUERIES}
ORACLE = {n: q for n, q in entry.oracle_sql().items() if n in registry.QUERIES}


def norm(v):
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def sort_key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF0001, t + '.parquet')}')")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"gbt_predictions", "gbt_metrics", "gbt_importances", "gbt_grid", "gbt_best", "gbt_by_crop",
                         "gbt_predictions_view", "gbt_holdout_metrics", "schema_report"}
    assert registry.GBT_PARAMS == model.DEFAULT_PARAMS and registry.GBT_GRID == model.PARAM_GRID
    assert set(ORACLE) <= set(QUERIES)


@pytest.fixture
def small_fits(monkeypatch):
    """The same queries over fewer trees; the SQL twins hold for any fit (grid points but for the tree counts)."""
    monkeypatch.setattr(registry, "GBT_PARAMS", {"maxIter": 3, "maxDepth": 3, "stepSize": 0.2})
    monkeypatch.setattr(registry, "GBT_GRID", {"maxIter": [1, 2, 3], "maxDepth": [1, 2, 3], "stepSize": [0.05, 0.1, 0.2]})
    monkeypatch.setitem(ORACLE, "gbt_prefix_rmse", ORACLE["gbt_prefix_rmse"].replace("(50), (100)", "(1), (2), (3)"))
    sql = ORACLE["gbt_grid_points"].replace("(0, 50), (1, 100), (2, 200)", "(0, 1), (1, 2), (2, 3)")
    monkeypatch.setitem(ORACLE, "gbt_grid_points", sql.replace("(0, 3), (1, 5), (2, 7)", "(0, 1), (1, 2), (2, 3)"))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, small_fits, name):
    df = QUERIES[name](spark, SF0001)
    cols = df.columns
    spark_rows = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=sort_key)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(cols)
    idx = {c: i for i, c in enumerate(rel.columns)}
    duck_rows = sorted((tuple(norm(r[idx[c]]) for c in sorted(cols)) for r in rel.fetchall()), key=sort_key)
    assert spark_rows == duck_rows


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 136
    assert len(df.columns) == 17
