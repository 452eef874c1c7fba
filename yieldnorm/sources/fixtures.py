"""Input tables of the analyses, derived from the driver's TPC-H-like parquet tables.

The original inputs (daily station weather, a county-yields report, a county GeoJSON, a FIPS
list and two anomaly tables) are not available; FIXTURES.md defines each one as a rule over the
given tables. Every function here returns a lazy DataFrame, so the derivations scale with the
tables they read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Market segments in alphabetical order (their 1-based position is the commodity
# code), and the two segments renamed to crops.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CROP_OF_SEGMENT = {"BUILDING": " Corn", "MACHINERY": " Soybeans"}


# The types of the given tables, declared so that no job reads a footer to infer them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per supplier; every 29th has no latitude."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    return s.select(
        k,
        F.when(k % 29 == 0, F.lit(None).cast("double"))
        .otherwise(((k * 17) % 54).cast("double") / 10).alias("latitude"),
        (((k * 37) % 56).cast("double") / 10).alias("longitude"),
    )


def weather_daily(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Daily observations: one per lineitem (or row of the given table or stream), located at its
    supplier's station."""
    li = (lineitem if lineitem is not None else table(spark, sf_dir, "lineitem")).select(
        "l_suppkey", "l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag",
        "l_linestatus", "l_shipdate")
    st = station(spark, sf_dir)
    j = li.join(st, li.l_suppkey == st.s_suppkey, "inner")
    no_temp = (F.year("l_shipdate") % 3) == 0
    price = F.floor("l_extendedprice")
    line = F.col("l_linenumber").cast(LongType())
    return j.select(
        "latitude",
        "longitude",
        F.col("l_shipdate").cast("date").alias("date"),
        F.floor("l_quantity").cast(LongType()).alias("precipitation"),
        F.when(no_temp, F.lit(None).cast(LongType())).otherwise(price % 400).alias("temp_max"),
        F.when(no_temp, F.lit(None).cast(LongType())).otherwise(price % 300 - 100).alias("temp_min"),
        F.when(F.col("l_returnflag") == "R", line).alias("snow_depth"),
        F.when(F.col("l_linestatus") == "F", line * 2).alias("snowfall"),
    )


def _vertex(x: Column, y: Column, alt: Column) -> Column:
    return F.when(alt, F.array(x, y, F.lit(100.0))).otherwise(F.array(x, y))


def county_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON features as (ord, properties, geometry{type, coordinates as JSON text}).

    One county per nation: the unit square at (k % 5, k div 5) with its low-left and up-right
    corners cut by 0.25. Every sixth county (k % 6 = 1) reaches 0.35 into its right neighbour;
    every third (k % 3 = 1) has a hole in the middle; every fourth (k % 4 = 3) is a MultiPolygon
    whose second part is an island north of the grid. Even keys use STATEFP/COUNTYFP/NAME, odd
    keys STATE/COUNTY/COUNTY_NAME; every third carries an altitude. One Point feature per region
    follows the counties and must be skipped.
    """
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    k = F.col("n_nationkey")
    cx = (k % 5).cast("double")
    cy = F.floor(k / 5).cast("double")
    alt = (k % 3) == 0
    right = cx + F.when((k % 6) == 1, F.lit(1.35)).otherwise(F.lit(1.0))

    def ring_of(*xy):
        return F.array(*[_vertex(x, y, alt) for x, y in xy])

    def square(x0, y0, x1, y1):
        return ring_of((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))

    outer = ring_of((cx + 0.25, cy), (right, cy), (right, cy + 0.75), (right - 0.25, cy + 1.0), (cx, cy + 1.0),
                    (cx, cy + 0.25), (cx + 0.25, cy))
    hole = square(cx + 0.25, cy + 0.25, cx + 0.75, cy + 0.75)
    island = square(cx + 0.25, F.lit(5.05), cx + 0.75, F.lit(5.35))
    polygon = F.when((k % 3) == 1, F.array(outer, hole)).otherwise(F.array(outer))
    multi = (k % 4) == 3
    region_s = F.col("n_regionkey").cast("string")
    key_s = k.cast("string")
    props = F.when(
        (k % 2) == 0,
        F.create_map(F.lit("STATEFP"), region_s, F.lit("COUNTYFP"), key_s, F.lit("NAME"), F.col("n_name")),
    ).otherwise(
        F.create_map(F.lit("STATE"), region_s, F.lit("COUNTY"), key_s, F.lit("COUNTY_NAME"), F.col("n_name")),
    )
    geometry = F.struct(
        F.when(multi, F.lit("MultiPolygon")).otherwise(F.lit("Polygon")).alias("type"),
        F.when(multi, F.to_json(F.array(polygon, F.array(island)))).otherwise(F.to_json(polygon)).alias("coordinates"),
    )
    counties = n.select(k.cast(LongType()).alias("ord"), props.alias("properties"), geometry.alias("geometry"))
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    points = r.select(
        (F.col("r_regionkey") + 1000).cast(LongType()).alias("ord"),
        F.create_map(F.lit("NAME"), F.col("r_name")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.lit("[0.5,0.5]").alias("coordinates")).alias("geometry"),
    )
    return counties.unionByName(points)


def county_ring_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The county features parsed into one row per ring (``sources.county_rings``)."""
    from .geojson import county_rings
    return county_rings(county_features(spark, sf_dir))


def county_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County yields report: one row per county, year, commodity and practice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    g = j.groupBy(
        "n_regionkey", "n_nationkey", "n_name", F.year("o_orderdate").alias("yy"), "c_mktsegment", "o_orderstatus"
    ).agg(F.max("o_orderkey").alias("mx"), F.max(F.col("o_orderkey") % 2400).alias("mm"))
    seg = F.col("c_mktsegment")
    crop = F.concat(F.lit(" "), seg)
    for s, name in CROP_OF_SEGMENT.items():
        crop = F.when(seg == s, F.lit(name)).otherwise(crop)
    return g.select(
        F.col("n_regionkey").alias("State Code"),
        F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("State Name"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("State Abbreviation"),
        F.col("n_nationkey").alias("County Code"),
        F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")).alias("County Name"),
        F.col("yy").alias("Yield Year"),
        F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), seg).cast("int").alias("Commodity Code"),
        crop.alias("Commodity Name"),
        F.col("o_orderstatus").alias("Irrigation Practice Code"),
        F.concat(F.lit("practice "), F.col("o_orderstatus")).alias("Irrigation Practice Name"),
        F.when(F.col("mx") % 11 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("mm").cast("double") / 10).alias("Yield Amount"),
    )


def fips_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIPS list: nations (every 7th left out, every 11th from 5 on listed twice under one key) plus
    one state-level row per region (null state)."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    k = F.col("n_nationkey")
    suffix = F.when(k % 3 == 0, " County").when(k % 3 == 1, " Parish").otherwise("")
    counties = (
        n.filter(k % 7 != 0)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            (F.col("r_regionkey") * 1000 + k).cast(LongType()).alias("fips"),
            F.concat(F.col("n_name"), suffix).alias("name"),
            F.substring("r_name", 1, 2).alias("state"),
        )
    )
    again = (
        n.filter(k % 11 == 5)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            (F.col("r_regionkey") * 1000 + 500 + k).cast(LongType()).alias("fips"),
            F.concat(F.lower("n_name"), F.lit(" county.")).alias("name"),
            F.substring("r_name", 1, 2).alias("state"),
        )
    )
    states = r.select(
        (F.col("r_regionkey") * 1000).cast(LongType()).alias("fips"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("state"),
    )
    return counties.unionByName(again).unionByName(states)


def _customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        c.filter(F.col("c_acctbal") < 0)
        .join(n, F.col("c_nationkey") == n.n_nationkey)
        .join(r, F.col("n_regionkey") == r.r_regionkey)
    )


def flagged_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly rows (customers with a negative balance) with raw, unnormalised place names."""
    p = _customer_places(spark, sf_dir)
    return p.select(
        "c_custkey",
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(". ")).alias("county"),
        F.lower(F.substring("r_name", 1, 2)).alias("state_abbr"),
        F.col("r_name").alias("state"),
        (F.lit(1995) + F.col("c_custkey") % 7).cast("int").alias("year"),
    )


def county_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (state, county) of the anomaly places, with the number of anomalies."""
    p = _customer_places(spark, sf_dir)
    return p.groupBy(
        F.col("r_name").alias("state"),
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(". ")).alias("county"),
    ).agg(F.count(F.lit(1)).alias("n_anomalies"))
