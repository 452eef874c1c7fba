"""Run one analysis against catalog tables or files and write its result tables.

    python -m yieldnorm training    --weather W --yields Y --counties C.geojson [--crop Corn] [--out-prefix p_]
    python -m yieldnorm correlation --weather W --yields Y --counties C.geojson [--out-prefix p_]
    python -m yieldnorm enrichment  --anomalies A --summary S --fips fips.csv [--out-prefix p_]

W, Y, A, S are catalog table names or parquet paths. Every result table is written with
``sinks.save_table`` as ``<out-prefix><name>`` (format ``--format``, parquet by default). The
session comes from the environment (spark-submit settings); ``spark.checkpoint.dir`` must name a
shared folder on a cluster.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import sinks
from .plans import notebooks
from .sources import anomalies, county_summary, read_county_rings, read_fips, weather, yields


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m yieldnorm")
    sub = p.add_subparsers(dest="analysis", required=True)
    for name in ("training", "correlation"):
        s = sub.add_parser(name)
        s.add_argument("--weather", required=True)
        s.add_argument("--yields", required=True)
        s.add_argument("--counties", required=True, help="GeoJSON FeatureCollection file")
        s.add_argument("--counties-lines", action="store_true",
                       help="--counties is line-delimited GeoJSON (one Feature per line; splittable)")
        s.add_argument("--years", default=None, help="first,last (filter pushed to the scan)")
        if name == "training":
            s.add_argument("--crop", default="Corn")
            s.add_argument("--params", default=None, help='JSON, e.g. {"maxIter": 100, "maxDepth": 7}')
        else:
            s.add_argument("--crops", default=None, help="comma-separated crop names as in the yields table, or 'all'")
    e = sub.add_parser("enrichment")
    e.add_argument("--anomalies", required=True)
    e.add_argument("--summary", required=True)
    e.add_argument("--fips", required=True, help="CSV with header fips,name,state")
    for s in sub.choices.values():
        s.add_argument("--quarantine", default=None, help="folder for malformed records of the inputs (weather text, FIPS lines, "
                       "feature lines) instead of stopping on them")
        s.add_argument("--out-prefix", default="")
        s.add_argument("--format", default="parquet")
    return p


def _rings(spark: SparkSession, a: argparse.Namespace, folder: str | None):
    """The counties; a FeatureCollection is one record, so only feature lines can be put aside."""
    return read_county_rings(spark, a.counties, a.counties_lines, folder if a.counties_lines else None)


def run(spark: SparkSession, argv: list[str] | None = None) -> dict[str, str]:
    """Run the analysis; return {result name: table written}."""
    a = build_parser().parse_args(argv)
    aside = {n: f"{a.quarantine.rstrip('/')}/{n}" if a.quarantine else None for n in ("weather", "fips", "counties")}
    years = tuple(int(v) for v in a.years.split(",")) if getattr(a, "years", None) else None
    if a.analysis == "training":
        out = notebooks.training(weather(spark, a.weather, aside["weather"]), _rings(spark, a, aside["counties"]),
                                 yields(spark, a.yields), crop=a.crop,
                                 params=json.loads(a.params) if a.params else None, years=years)
    elif a.analysis == "correlation":
        chosen = {} if a.crops is None else {"crops": None if a.crops == "all" else a.crops.split(",")}
        out = notebooks.correlation(weather(spark, a.weather, aside["weather"]), _rings(spark, a, aside["counties"]),
                                    yields(spark, a.yields), years=years, **chosen)
    else:
        out = notebooks.enrichment(anomalies(spark, a.anomalies), county_summary(spark, a.summary),
                                   read_fips(spark, a.fips, quarantine=aside["fips"]))
    written = {}
    for name, df in out.items():
        table = f"{a.out_prefix}{name}"
        sinks.save_table(df, table, fmt=a.format)
        written[name] = table
    return written


def main() -> None:
    import sys
    build_parser().parse_args()  # usage errors and --help exit before a session starts
    spark = SparkSession.builder.appName("yieldnorm").getOrCreate()
    for name, table in run(spark, sys.argv[1:]).items():
        print(f"{name}\t{table}")


if __name__ == "__main__":
    main()
