"""Adaptive quadtree cover of polygon rings: the index of J1 for large or uneven counties.

Every ring gets squares of a grid whose cell sizes are powers of two, so that squares of all rings and levels nest. A
ring begins with the few squares of its own extent; a square is split in four while it holds more than ``LEAF_EDGES``
edges (and at first in any case, ``MIN_DEPTH`` times), at most ``MAX_DEPTH`` times. A leaf without edges lies wholly
inside or wholly outside its ring: inside ones are kept and need no test, outside ones go. A leaf with edges is a
boundary leaf: its points are tested against the edges at their latitude.

A ring has at most about 4 ** MAX_DEPTH leaves, and as a rule some hundred, whatever its extent is against that of
other rings; a uniform grid gives it (extent / cell) ** 2 cells. The tree is built inside the ring's row by higher-order
functions: no shuffle, no Python.

Exactness: an edge counts as touching a square when it meets the square widened by ``MARGIN`` of the ring's ordinates.
Edges that don't are far enough from all points of the square for the ray test to give them all the same answer, so that
an inside leaf's points equal those found by the ray test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell_of, edges_contain, ring_edges

MIN_DEPTH, MAX_DEPTH, LEAF_EDGES = 3, 8, 8
MARGIN = 1e-9


def _size(level: Column) -> Column:
    """Side of a square: 2 ** level, exact for whole numbers."""
    return F.pow(F.lit(2.0), level.cast("double"))


def _touches(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The edge meets the box: their extents overlap, and the box has no empty side of the edge's line to itself."""
    def side(x, y):
        return (e["xb"] - e["xa"]) * (y - e["ya"]) - (e["yb"] - e["ya"]) * (x - e["xa"])

    corners = [side(x, y) for x in (x0, x1) for y in (y0, y1)]
    return ((F.least(e["xa"], e["xb"]) <= x1) & (F.greatest(e["xa"], e["xb"]) >= x0)
            & (F.least(e["ya"], e["yb"]) <= y1) & (F.greatest(e["ya"], e["yb"]) >= y0)
            & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0))


def _square(level: Column, cx: Column, cy: Column, edges: Column) -> Column:
    """A node: its place and those of ``edges`` that touch it."""
    s, m = _size(level), F.col("__margin")
    return F.struct(level.cast("int").alias("level"), cx.cast("long").alias("cx"), cy.cast("long").alias("cy"),
                    F.filter(edges, lambda e: _touches(e, cx * s - m, cy * s - m, (cx + 1) * s + m, (cy + 1) * s + m))
                    .alias("edges"))


def _split_once(nodes: Column) -> Column:
    def children(n):
        depth, many = F.col("__top") - n["level"], F.size(n["edges"])
        wide = _size(n["level"]) > 1000 * F.col("__margin")  # else the margin alone would fill all four
        split = wide & (many > 0) & ((depth < MIN_DEPTH) | (many > LEAF_EDGES))
        four = [_square(n["level"] - 1, n["cx"] * 2 + i, n["cy"] * 2 + j, n["edges"]) for j in (0, 1) for i in (0, 1)]
        return F.when(split, F.array(*four)).otherwise(F.array(n))

    return F.flatten(F.transform(nodes, children))


def _prepared(rings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rings with an area, their edges, their top level and the height of their latitude bands: the mean height of an
    edge, so that all edges together lie in at most about twice as many bands as there are edges."""
    r = rings.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    r = r.select(*columns, "x0", "y0", "x1", "y1", ring_edges("ring").alias("__edges"))
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    climb = F.aggregate("__edges", F.lit(0.0), lambda acc, e: acc + F.abs(e["ya"] - e["yb"]))
    far = F.greatest(*[F.abs(F.col(c)) for c in ("x0", "y0", "x1", "y1")])
    return r.withColumns({"__top": F.ceil(F.log2(extent)).cast("int"), "__margin": (far + extent) * MARGIN,
                          "__height": climb / F.size("__edges")})


def _leaves(prepared: DataFrame, columns: Sequence[str]) -> DataFrame:
    """columns, y0, __height, level, cx, cy, boundary of every leaf, outside ones too."""
    top, size = F.col("__top"), _size(F.col("__top"))
    xs, ys = (F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)) for a, b in (("x0", "x1"), ("y0", "y1")))
    first = F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: _square(top, i, j, F.col("__edges")))))
    nodes = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DEPTH)), first, lambda acc, _: _split_once(acc))
    rows = prepared.select(*columns, "y0", "__height", F.explode(F.transform(nodes, lambda n: F.struct(
        n["level"].alias("level"), n["cx"].alias("cx"), n["cy"].alias("cy"),
        (F.size(n["edges"]) > 0).alias("boundary")))).alias("n"))
    return rows.select(*columns, "y0", "__height", "n.*")


def _band(lat: Column) -> Column:
    """Band of a latitude in its ring: monotone in ``lat``, so that an edge across ``lat`` is in the band."""
    return F.floor((lat - F.col("y0")) / F.col("__height"))


def edge_bands(prepared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, band, edges: the non-horizontal edges of each latitude band of each ring."""
    e = prepared.select(*keys, "y0", "__height", F.explode("__edges").alias("e")).filter(F.col("e.ya") != F.col("e.yb"))
    span = F.sequence(_band(F.least("e.ya", "e.yb")), _band(F.greatest("e.ya", "e.yb")))
    return e.select(*keys, "e", F.explode(span).alias("band")).groupBy(*keys, "band").agg(F.collect_list("e").alias("edges"))


def _without_outside(rows: DataFrame, bands: DataFrame, keys: Sequence[str], test: Column, lon: Column, lat: Column) -> DataFrame:
    """``rows`` (keys, y0, __height, ...) without those under ``test`` whose point (lon, lat) lies outside their ring.
    The others have no band, so meet no edges."""
    j = rows.withColumns({"__test": test, "__lon": lon, "__lat": lat, "band": F.when(test, _band(lat))})
    j = j.join(bands, [*keys, "band"], "left")
    inside = F.col("edges").isNotNull() & edges_contain("edges", "__lon", "__lat")
    return j.filter(~F.col("__test") | inside).drop("edges", "band", "__test", "__lon", "__lat")


def cover(rings: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """The leaves that hold points of their ring: keys, carried, y0, __height, level, cx, cy, boundary. Each point inside
    a ring lies in exactly one of them. ``keys`` identify a ring, none is null; ``carried`` are more columns of it."""
    prepared = _prepared(rings, [*keys, *carried])
    every = _leaves(prepared, [*keys, *carried])
    mid = {c: (F.col(c) + 0.5) * _size(F.col("level")) for c in ("cx", "cy")}
    return _without_outside(every, edge_bands(prepared, keys), keys, ~F.col("boundary"), mid["cx"], mid["cy"])


def levels(rings: DataFrame) -> list[int]:
    """Levels that leaves may have, from the rings' extents (some tens of numbers reach the driver)."""
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    tops = rings.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).select(
        F.ceil(F.log2(extent)).cast("int").alias("top")).distinct().collect()
    return sorted({r.top - k for r in tops for k in range(MAX_DEPTH + 1)})


def containing(points: DataFrame, rings: DataFrame, keys: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """(latitude, longitude, keys, carried) for each ring that holds the point. ``points`` are distinct; a point looks up its
    square on every level in use, an equi-join. Without rings there are no rows."""
    sides = F.array(*[F.lit(e) for e in levels(rings)] or [F.lit(0)])
    p = points.select("latitude", "longitude", F.explode(sides).alias("level"))
    p = p.withColumns({"cx": cell_of("longitude", _size(F.col("level"))), "cy": cell_of("latitude", _size(F.col("level")))})
    met = p.join(cover(rings, keys, carried), ["level", "cx", "cy"]).drop("level", "cx", "cy")
    bands = edge_bands(_prepared(rings, keys), keys)
    hits = _without_outside(met, bands, keys, F.col("boundary"), F.col("longitude"), F.col("latitude"))
    return hits.select("latitude", "longitude", *keys, *carried)
