"""County polygons from a GeoJSON FeatureCollection, as one row per ring.

The geometry's ``coordinates`` are read as raw JSON text and parsed with ``from_json`` by
geometry type, so Polygon (rings) and MultiPolygon (polygons of rings) share one schema.
Output of :func:`county_rings` (one row per ring)::

    ord               feature position (long; (file, position) struct for line-delimited input);
                      the first feature wins on overlap
    state_code str    STATEFP | STATE, zero-filled to 2
    county_code str   COUNTYFP | COUNTY, zero-filled to 3
    county_name str   NAME | COUNTY_NAME | 'Unknown'
    poly_no, ring_no  position of the polygon in the feature, of the ring in the polygon
    ring              array<array<double>> of (x, y); altitude dropped
    x0, y0, x1, y1    bounding box of the ring
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, LongType, MapType, StringType,
                               StructField, StructType)

from ..functions.codes import first_key, zfill
from ..functions.geometry import bbox_of_ring, two_d
from . import quarantine as aside

GEOMETRY_SCHEMA = StructType([
    StructField("type", StringType(), True),
    StructField("coordinates", StringType(), True),  # raw JSON text, parsed per type below
])
FEATURE_SCHEMA = StructType([
    StructField("properties", MapType(StringType(), StringType()), True),
    StructField("geometry", GEOMETRY_SCHEMA, True),
])
COLLECTION_SCHEMA = StructType([
    StructField("type", StringType(), True),
    StructField("features", ArrayType(FEATURE_SCHEMA), True),
])

_POINT = ArrayType(DoubleType())
_RING = ArrayType(_POINT)
_POLYGON = ArrayType(_RING)
_MULTI = ArrayType(_POLYGON)

# Property keys tried in order, and the defaults used when none is present.
STATE_KEYS = ("STATEFP", "STATE")
COUNTY_KEYS = ("COUNTYFP", "COUNTY")
NAME_KEYS = ("NAME", "COUNTY_NAME")
NAME_DEFAULT = "Unknown"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a FeatureCollection file: (ord, properties, geometry).

    The collection is one JSON document, so one task parses it; the features are then
    spread over ``spark.sql.shuffle.partitions`` partitions before any geometry work. A file
    that is cut off or no FeatureCollection raises.
    """
    fc = spark.read.schema(COLLECTION_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    whole = (F.col("type") == "FeatureCollection") & F.col("features").isNotNull()
    fc = fc.select(F.when(whole, F.col("features")).otherwise(
        F.raise_error(F.concat(F.lit("not a FeatureCollection: "), F.input_file_name()))).alias("features"))
    feats = fc.select(F.posexplode("features").alias("ord", "f"))
    return feats.select(
        F.col("ord").cast(LongType()).alias("ord"),
        F.col("f.properties").alias("properties"),
        F.col("f.geometry").alias("geometry"),
    ).repartition("ord")


def read_feature_lines(spark: SparkSession, path: str, quarantine: str | None = None) -> DataFrame:
    """Features of line-delimited GeoJSON (one Feature object per line, RFC 8142 style): the
    files split across tasks like any JSON-lines input. ``ord`` is (file path, position), which
    orders features by file, then by line, for the first-feature-wins rule. A line that is no feature stops the job; with
    a ``quarantine`` folder it goes there, as do polygons with bad coordinates (which else stop ``county_rings``)."""
    place = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos")).alias("ord")
    if quarantine is None:
        return spark.read.schema(FEATURE_SCHEMA).option("mode", "FAILFAST").json(path).select(place, "properties", "geometry")
    feats = spark.read.schema(aside.permissive(FEATURE_SCHEMA)).options(**aside.options()).json(path)
    wanted, parsed = _polygons_of()
    reason = F.when(F.col(aside.RAW).isNotNull(), "no feature").when(wanted & ~_sound(parsed), "bad coordinates")
    raw = F.coalesce(F.col(aside.RAW), F.to_json(F.struct("properties", "geometry")))
    return aside.put_aside(feats.select(place, "properties", "geometry", aside.RAW), raw, reason,
                           ["ord", "properties", "geometry"], quarantine)


def _polygons_of() -> tuple[Column, Column]:
    """Whether a feature is a (multi)polygon, and its polygons."""
    gtype, coords = F.col("geometry.type"), F.col("geometry.coordinates")
    parsed = (F.when(gtype == "Polygon", F.array(F.from_json(coords, _POLYGON)))
              .when(gtype == "MultiPolygon", F.from_json(coords, _MULTI)))
    return F.coalesce(gtype.isin("Polygon", "MultiPolygon"), F.lit(False)), parsed


def _sound(polygons: Column) -> Column:
    """Every polygon, ring and point is there, and a point has two finite ordinates or more."""
    def point(p):
        return p.isNotNull() & (F.size(p) >= 2) & F.forall(p, lambda o: o.isNotNull() & (F.abs(o) < float("inf")))

    def all_of(test):
        return lambda a: a.isNotNull() & F.forall(a, test)

    return F.coalesce(all_of(all_of(all_of(point)))(polygons), F.lit(False))


def county_rings(features: DataFrame) -> DataFrame:
    """Rings of every Polygon / MultiPolygon feature; other or null geometries are skipped. A
    polygon whose coordinates don't parse, or hold a missing or non-finite ordinate, raises."""
    props = F.col("properties")
    coords = F.col("geometry.coordinates")
    wanted, parsed = _polygons_of()
    polygons = F.when(~wanted, F.lit(None)).when(_sound(parsed), parsed).otherwise(F.raise_error(F.concat(
        F.lit("bad coordinates in feature "), F.coalesce(F.to_json("properties"), F.lit("null")), F.lit(": "), F.coalesce(F.substring(coords, 1, 200), F.lit("null")))))
    feats = features.filter(wanted).select(
        "ord",
        zfill(first_key(props, STATE_KEYS, ""), 2).alias("state_code"),
        zfill(first_key(props, COUNTY_KEYS, ""), 3).alias("county_code"),
        first_key(props, NAME_KEYS, NAME_DEFAULT).alias("county_name"),
        polygons.alias("polygons"),
    )
    polys = feats.select("ord", "state_code", "county_code", "county_name",
                         F.posexplode("polygons").alias("poly_no", "poly"))
    rings = polys.select("ord", "state_code", "county_code", "county_name", "poly_no",
                         F.posexplode("poly").alias("ring_no", "ring"))
    rings = rings.withColumn("ring", two_d("ring")).filter(F.size("ring") > 0)
    x0, y0, x1, y1 = bbox_of_ring("ring")
    return rings.select("ord", "state_code", "county_code", "county_name", "poly_no", "ring_no",
                        "ring", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def read_county_rings(spark: SparkSession, path: str, lines: bool = False, quarantine: str | None = None) -> DataFrame:
    """Rings from a FeatureCollection file, or from line-delimited features with ``lines``; these may put bad features
    aside (a collection is one record, so it can't)."""
    if quarantine is not None and not lines:
        raise ValueError("quarantine needs line-delimited features")
    return county_rings(read_feature_lines(spark, path, quarantine) if lines else read_features(spark, path))
