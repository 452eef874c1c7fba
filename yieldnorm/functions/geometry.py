"""Column expressions for polygon rings stored as ``array<array<double>>`` of (x, y) points.

A ring is tested with even-odd ray casting: a horizontal ray from the point to +x, an edge
(p_i, p_j) with j = i - 1 (the last vertex for i = 0) counts when
``(y_i > lat) != (y_j > lat)`` and ``lon < (x_j - x_i) * (lat - y_i) / (y_j - y_i) + x_i``;
an odd count means inside. Axis-aligned edges are therefore half-open (low edge in, high edge
out). Everything is a higher-order built-in, so it runs inside the JVM with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def two_d(ring: Column | str) -> Column:
    """Keep the first two ordinates of every point (drops altitude / measures)."""
    return F.transform(_c(ring), lambda p: F.array(p[0], p[1]))


def bbox_of_ring(ring: Column | str) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y) of a ring."""
    r = _c(ring)
    xs = F.transform(r, lambda p: p[0])
    ys = F.transform(r, lambda p: p[1])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def ring_contains(ring: Column | str, lon: Column | str, lat: Column | str) -> Column:
    """True when (lon, lat) is inside the ring by even-odd ray casting."""
    r, x, y = _c(ring), _c(lon), _c(lat)
    # previous vertex of each vertex: [last, first, second, ..., second to last]
    prev = F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.size(r) - 1))
    crossings = F.zip_with(
        r,
        prev,
        lambda pi, pj: ((pi[1] > y) != (pj[1] > y))
        & (x < (pj[0] - pi[0]) * (y - pi[1]) / F.nullif(pj[1] - pi[1], F.lit(0.0)) + pi[0]),
    )
    return (F.size(F.filter(crossings, lambda c: c)) % 2) == 1


def cell_of(v: Column | str, cell: float | Column) -> Column:
    """Grid cell index of a coordinate: floor(v / cell). Monotone in v, so a point inside a
    bounding box always falls in a cell the box covers (for any positive cell size)."""
    size = cell if isinstance(cell, Column) else F.lit(float(cell))
    return F.floor(_c(v) / size)


def ring_edges(ring: Column | str) -> Column:
    """The ring's edges as structs (xa, ya) = vertex, (xb, yb) = previous vertex."""
    r = _c(ring)
    prev = F.concat(F.slice(r, -1, 1), F.slice(r, 1, F.size(r) - 1))
    return F.zip_with(r, prev, lambda a, b: F.struct(a[0].alias("xa"), a[1].alias("ya"),
                                                     b[0].alias("xb"), b[1].alias("yb")))


def edges_contain(edges: Column | str, lon: Column | str, lat: Column | str) -> Column:
    """Even-odd test over a subset of a ring's edges (those that can reach the point's latitude);
    the same arithmetic as :func:`ring_contains`."""
    x, y = _c(lon), _c(lat)
    crossing = F.filter(
        _c(edges),
        lambda e: ((e["ya"] > y) != (e["yb"] > y))
        & (x < (e["xb"] - e["xa"]) * (y - e["ya"]) / F.nullif(e["yb"] - e["ya"], F.lit(0.0)) + e["xa"]),
    )
    return (F.size(crossing) % 2) == 1
