"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed to completion with the ``noop`` sink (the whole plan runs, nothing is
collected to the driver); the reported time is the best of ``$BENCH_REPEAT`` runs (default 2).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from yieldnorm.operators import model, rank  # noqa: E402
from yieldnorm.plans import queries as Q  # noqa: E402
from yieldnorm.session import local_session  # noqa: E402

HEADLINE = [
    "geo_mapping",            # J1 point-in-polygon over distinct station coordinates
    "weather_with_county",    # J2 per-row county attach (size-checked broadcast)
    "annual_sum",             # A1 station-year pre-aggregation + county-year re-aggregation
    "annual_avg",             # A2 + P13
    "fact_sum",               # J3 + P1 flagship
    "crop_zscore",            # P18
    "pearson",                # A8
    "top50_abs_residual",     # M8 + P16 + T-1
    "residual_consistency",   # R2
    "anomalies_geo",          # J4 + P9-P12
    "county_summary_geo",     # J5/J6 + A10
    "gbt_predictions",        # M1-M4: the fit (stored once per run), load and score
]


def q_gbt_reference(spark, d):
    """The original's single fit: Corn, 100 trees of depth 7, step 0.2, scored in-sample."""
    ml = Q._corn_ml(spark, d)
    return rank.layout(model.predict(model.fit(ml, model.DEFAULT_PARAMS), ml))


def q_gbt_grid(spark, d):
    """The original's grid of 27 points (9 fits of 200 trees), not taken from an earlier run."""
    return model.grid(Q._corn_ml(spark, d), model.PARAM_GRID, parallelism=Q.GBT_THREADS)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    with_ref = os.environ.get("BENCH_GBT_REFERENCE", "1") == "1"
    spark = local_session(cpus, app="yieldnorm-bench")
    queries = {n: Q.QUERIES[n] for n in HEADLINE}
    if with_ref:
        queries["gbt_reference"] = q_gbt_reference
    if os.environ.get("BENCH_GBT_GRID", "0") == "1":  # some minutes
        queries["gbt_grid"] = q_gbt_grid
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    if only:
        queries = {n: f for n, f in queries.items() if n in only}
    run(Q.QUERIES["src_fips"](spark, sf_dir))  # warm-up: JVM, parquet reader, codegen
    times = {}
    for name, fn in queries.items():
        best = None
        for _ in range(1 if name.startswith("gbt") else repeat):
            t0 = time.perf_counter()
            run(fn(spark, sf_dir))
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        print(f"{name}: {best:.2f}s", file=sys.stderr)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
