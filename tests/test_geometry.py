import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from yieldnorm.functions.geometry import bbox_of_ring, ring_contains, two_d


def py_in_ring(lon, lat, ring):
    """Specification of the even-odd rule: count the edges (vertex, previous vertex) that a ray
    from the point towards +x crosses; the crossing abscissa uses the same arithmetic order as
    the Spark expression."""
    pts = [(p[0], p[1]) for p in ring]
    pairs = zip(pts, pts[-1:] + pts[:-1])
    crossings = sum(
        1 for (xa, ya), (xb, yb) in pairs
        if (ya > lat) != (yb > lat) and lon < (xb - xa) * (lat - ya) / (yb - ya) + xa
    )
    return crossings % 2 == 1


def spark_in_ring(spark, ring, points):
    df = spark.createDataFrame([(ring, float(x), float(y)) for x, y in points],
                               "ring array<array<double>>, lon double, lat double")
    return [r[0] for r in df.select(ring_contains("ring", "lon", "lat")).collect()]


def test_square_is_half_open(spark):
    sq = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0], [0.0, 0.0]]
    pts = [(0, 0), (10, 10), (5, 5), (10, 5), (5, 10), (0, 5), (5, 0), (-1, 5), (11, 5)]
    assert spark_in_ring(spark, sq, pts) == [True, False, True, False, False, True, True, False, False]


def test_horizontal_edge_at_point_latitude(spark):
    # a zero-height edge must not raise (ANSI division by zero) and must not count
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [2.0, 2.0], [2.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    pts = [(1, 2), (3, 2), (1, 0), (3, 3), (1, 3)]
    assert spark_in_ring(spark, ring, pts) == [py_in_ring(x, y, ring) for x, y in pts]


def test_unclosed_ring_matches_spec(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]  # not closed: the j = i-1 wrap closes it
    pts = [(1, 1), (5, 1), (3.9, 3.9)]
    assert spark_in_ring(spark, ring, pts) == [py_in_ring(x, y, ring) for x, y in pts]


def test_two_d_and_bbox(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 100.0], [3.0, -1.0, 5.0], [0.5, 4.0, 7.0]],)], "r array<array<double>>")
    row = df.select(two_d("r").alias("r2"), *[c.alias(n) for c, n in zip(bbox_of_ring("r"), "abcd")]).first()
    assert row["r2"] == [[1.0, 2.0], [3.0, -1.0], [0.5, 4.0]]
    assert (row["a"], row["b"], row["c"], row["d"]) == (0.5, -1.0, 3.0, 4.0)


coord = st.integers(min_value=-8, max_value=8).map(lambda v: v / 2.0)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(coord, coord), min_size=3, max_size=9),
       st.lists(st.tuples(coord, coord), min_size=1, max_size=12))
def test_random_polygons_match_plain_loop(spark, verts, pts):
    ring = [[float(x), float(y)] for x, y in verts] + [[float(verts[0][0]), float(verts[0][1])]]
    assert spark_in_ring(spark, ring, pts) == [py_in_ring(x, y, ring) for x, y in pts]


def test_random_float_polygons(spark):
    rnd = random.Random(7)
    for _ in range(5):
        ring = [[rnd.uniform(-3, 3), rnd.uniform(-3, 3)] for _ in range(12)]
        ring.append(list(ring[0]))
        pts = [(rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for _ in range(40)]
        assert spark_in_ring(spark, ring, pts) == [py_in_ring(x, y, ring) for x, y in pts]
