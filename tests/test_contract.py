"""The driver contract: bench.py prints one JSON line; entry() keeps a stable schema."""

import json
import os
import subprocess
import sys

import __spark_entry__ as entry
from yieldnorm.operators import fact

from .conftest import SF0001

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF0001, BENCH_CPUS="2", BENCH_REPEAT="1", BENCH_GBT_REFERENCE="0",
               BENCH_ONLY="anomalies_geo,county_summary_geo")
    out = subprocess.run([sys.executable, os.path.join(REPO, "bench.py")], env=env, capture_output=True, text=True,
                         timeout=600, check=True)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    doc = json.loads(lines[0])
    assert doc["unit"] == "sec" and doc["sf"] == 0.001 and set(doc["queries"]) == {"anomalies_geo", "county_summary_geo"}
    assert abs(doc["value"] - sum(doc["queries"].values())) < 1e-6


def test_entry_schema_is_the_fact_layout(spark):
    df = entry.entry(spark)
    assert df.columns == fact.columns("sum")
    assert set(entry.oracle_sql()) <= set(entry.queries())
