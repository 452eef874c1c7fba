import math
import random

from pyspark.sql import functions as F

from yieldnorm.operators import geo, quadtree

from .test_geometry import py_in_ring

SCHEMA = ("ord long, state_code string, county_code string, county_name string, poly_no int, ring_no int, "
          "ring array<array<double>>, x0 double, y0 double, x1 double, y1 double")


def row(i, ring):
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return (i, "01", f"{i:03d}", f"P{i}", 0, 0, [list(map(float, p)) for p in ring],
            float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys)))


def circle(x, y, r, n):
    return [[x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)] for k in range(n)]


def assigned(points, rings):
    return {(r.latitude, r.longitude): r.geo_county_name for r in geo.assign(points, rings, refine="quadtree").collect()}


def first(lon, lat, rows):
    return next((r[3] for r in rows if py_in_ring(lon, lat, r[6])), "Unknown")


def test_uneven_rings_equal_the_plain_loop(spark):
    """Random self-crossing polygons, a ring a thousand times their size, and one far from the origin."""
    rnd = random.Random(5)
    rows = [row(i, [[rnd.uniform(0, 6), rnd.uniform(0, 6)] for _ in range(rnd.randint(3, 40))]) for i in range(6)]
    rows.append(row(6, circle(0, 0, 3000, 700)))
    rows.append(row(7, circle(4e6, -5e6, 40, 90)))
    pts = [(rnd.uniform(-0.5, 6.5), rnd.uniform(-0.5, 6.5)) for _ in range(200)]
    pts += [(rnd.uniform(-3100, 3100), rnd.uniform(-3100, 3100)) for _ in range(300)]
    pts += [(4e6 + rnd.uniform(-50, 50), -5e6 + rnd.uniform(-50, 50)) for _ in range(200)]
    pts += [tuple(p) for r in rows for p in r[6][:20]]  # vertices lie on the boundary
    got = assigned(spark.createDataFrame([(float(y), float(x)) for x, y in pts], "latitude double, longitude double"),
                   spark.createDataFrame(rows, SCHEMA))
    assert got == {(float(y), float(x)): first(x, y, rows) for x, y in pts}


def test_points_on_edges_of_squares(spark):
    """Edges along grid lines of every level, and points on them."""
    rows = [row(0, [[0, 0], [8, 0], [8, 8], [0, 8]]), row(1, [[8, 0], [16, 0], [16, 4], [8, 4], [8, 0]]),
            row(2, [[-4, -4], [0, -4], [0, 0], [-4, 0]])]
    pts = [(x / 2, y / 2) for x in range(-9, 34) for y in range(-9, 18)]
    got = assigned(spark.createDataFrame([(y, x) for x, y in pts], "latitude double, longitude double"),
                   spark.createDataFrame(rows, SCHEMA))
    assert got == {(y, x): first(x, y, rows) for x, y in pts}


def test_a_wide_ring_has_few_leaves_and_linear_bands(spark):
    """A ring 1,000 cells of the grid wide; a comb whose edges all span its height."""
    comb = [p for k in range(400) for p in ([k, 0], [k + 0.5, 1000])] + [[400, -1], [0, -1]]
    rows = [row(i, circle(i, 0, 0.5, 12)) for i in range(9)] + [row(9, circle(0, 0, 500, 2000)), row(10, comb)]
    rings = spark.createDataFrame(rows, SCHEMA)
    cell = geo.cell_size(rings)
    assert 900 < 1000 / cell < 1100
    assert geo.ring_cells(rings.filter("ord = 9"), cell).count() > 900_000
    cover = {r.ord: (r["n"], r.inside) for r in quadtree.cover(rings, geo.RING_ID).groupBy("ord").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("boundary")).cast("long")).alias("inside")).collect()}
    assert cover[9][0] < 10_000 and cover[9][1] > 100
    bands = quadtree.edge_bands(quadtree._prepared(rings, geo.RING_ID), geo.RING_ID)
    for r in bands.groupBy("ord").agg(F.sum(F.size("edges")).alias("n")).collect():
        assert r["n"] <= 3 * len(rows[r.ord][6])


def test_leaves_cover_each_inside_point_once(spark):
    rnd = random.Random(9)
    ring = row(0, [[rnd.uniform(0, 100), rnd.uniform(0, 100)] for _ in range(60)])
    leaves = quadtree.cover(spark.createDataFrame([ring], SCHEMA), geo.RING_ID).collect()
    for _ in range(2000):
        x, y = rnd.uniform(0, 100), rnd.uniform(0, 100)
        own = [n for n in leaves if (math.floor(x / 2.0 ** n.level), math.floor(y / 2.0 ** n.level)) == (n.cx, n.cy)]
        assert len(own) <= 1
        if py_in_ring(x, y, ring[6]):
            assert own
        elif own:
            assert own[0].boundary


def test_no_rings_and_flat_rings(spark):
    p = spark.createDataFrame([(0.5, 0.5), (0.0, 0.0)], "latitude double, longitude double")
    assert set(assigned(p, spark.createDataFrame([], SCHEMA)).values()) == {"Unknown"}
    flat = [row(0, [[0, 0], [1, 0]]), row(1, [[0.5, 0], [0.5, 1]]), row(2, [[0.5, 0.5]])]
    assert set(assigned(p, spark.createDataFrame(flat, SCHEMA)).values()) == {"Unknown"}


def test_codes_may_be_null(spark):
    r = list(row(0, circle(0, 0, 10, 30)))
    r[3] = None
    got = geo.assign(spark.createDataFrame([(1.0, 1.0), (9.9, 0.1)], "latitude double, longitude double"),
                     spark.createDataFrame([tuple(r)], SCHEMA), keep_unknown=False, refine="quadtree").collect()
    assert all((g.geo_state_code, g.geo_county_name) == ("01", None) for g in got)
    assert {g.latitude for g in got} >= {1.0}
