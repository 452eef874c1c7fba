import json

import pytest

from yieldnorm.operators import geo
from yieldnorm.sources import read_county_rings

from .test_geometry import py_in_ring

SQ = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]

FEATURES = [
    # 0: polygon with a hole (the hole counts as inside by default)
    {"type": "Feature", "properties": {"STATEFP": "1", "COUNTYFP": "1", "NAME": "Holed"},
     "geometry": {"type": "Polygon", "coordinates": [SQ(0, 0, 4, 4), SQ(1, 1, 2, 2)]}},
    # 1: multipolygon with two parts, key variants, altitude on points
    {"type": "Feature", "properties": {"STATE": 2, "COUNTY": "22", "COUNTY_NAME": "Twin"},
     "geometry": {"type": "MultiPolygon", "coordinates": [
         [[[10, 0, 5], [12, 0, 5], [12, 2, 5], [10, 2, 5], [10, 0, 5]]],
         [[[20, 0], [22, 0], [22, 2], [20, 2], [20, 0]]]]}},
    # 2 and 3: overlapping counties, the first one wins
    {"type": "Feature", "properties": {"STATEFP": "03", "COUNTYFP": "003", "NAME": "First"},
     "geometry": {"type": "Polygon", "coordinates": [SQ(30, 0, 34, 4)]}},
    {"type": "Feature", "properties": {"STATEFP": "04", "COUNTYFP": "004", "NAME": "Second"},
     "geometry": {"type": "Polygon", "coordinates": [SQ(32, 0, 36, 4)]}},
    # 4: a point feature (skipped), 5: null geometry (skipped)
    {"type": "Feature", "properties": {"NAME": "Pt"}, "geometry": {"type": "Point", "coordinates": [1, 1]}},
    {"type": "Feature", "properties": {"NAME": "Null"}, "geometry": None},
    # 6: unclosed ring with a horizontal edge at y = 2, no name (default 'Unknown')
    {"type": "Feature", "properties": {"STATEFP": "5", "COUNTYFP": "5"},
     "geometry": {"type": "Polygon", "coordinates": [[[40, 0], [44, 0], [44, 2], [42, 2], [42, 4], [40, 4]]]}},
]

POINTS = [(0.5, 0.5), (1.5, 1.5), (3.99, 3.99), (4.0, 4.0), (11, 1), (21, 1), (15, 1), (31, 1), (33, 1), (35, 1),
          (41, 2), (43, 2), (43, 3), (100, 100), (0.0, 0.0)]


def _first(props, keys, default):
    present = [props[k] for k in keys if props.get(k) is not None]
    return present[0] if present else default


def expected_county(lon, lat, feats):
    """Specification: the first (Multi)Polygon feature with any ring containing the point."""
    counties = []
    for f in feats:
        g = f.get("geometry") or {}
        parts = {"Polygon": lambda c: [c], "MultiPolygon": lambda c: c}.get(g.get("type"))
        if parts is None:
            continue
        rings = [ring for poly in parts(g["coordinates"]) for ring in poly]
        props = f.get("properties") or {}
        codes = (str(_first(props, ("STATEFP", "STATE"), "")).zfill(2),
                 str(_first(props, ("COUNTYFP", "COUNTY"), "")).zfill(3),
                 _first(props, ("NAME", "COUNTY_NAME"), "Unknown"))
        counties.append((codes, rings))
    hit = next((codes for codes, rings in counties if any(py_in_ring(lon, lat, r) for r in rings)), None)
    return hit or ("-1", "-1", "Unknown")


@pytest.fixture(scope="module")
def rings(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("geo") / "counties.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=2))
    return read_county_rings(spark, str(path))


def test_rings_parsed(rings):
    rows = rings.orderBy("ord", "poly_no", "ring_no").collect()
    assert [(r.ord, r.poly_no, r.ring_no) for r in rows] == [(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 1, 0), (2, 0, 0),
                                                             (3, 0, 0), (6, 0, 0)]
    r1 = [r for r in rows if r.ord == 1][0]
    assert (r1.state_code, r1.county_code, r1.county_name) == ("02", "022", "Twin")
    assert r1.ring[0] == [10.0, 0.0]  # altitude dropped
    r6 = [r for r in rows if r.ord == 6][0]
    assert (r6.state_code, r6.county_code, r6.county_name) == ("05", "005", "Unknown")


@pytest.mark.parametrize("cell,refine", [(0.5, "ring"), (1.0, "ring"), (7.0, "ring"), (0.5, "bands"), (7.0, "bands"),
                                         ("auto", "quadtree")])
def test_assign_matches_plain_loop(spark, rings, cell, refine):
    pts = spark.createDataFrame([(float(y), float(x)) for x, y in POINTS] + [(None, 1.0), (1.0, None)],
                                "latitude double, longitude double")
    got = {(r.latitude, r.longitude): (r.geo_state_code, r.geo_county_code, r.geo_county_name)
           for r in geo.assign(pts, rings, cell=cell, refine=refine).collect()}
    want = {(float(y), float(x)): expected_county(x, y, FEATURES) for x, y in POINTS}
    assert got == want  # null coordinates are dropped (D1)
    known = {(r.latitude, r.longitude): r.geo_county_name
             for r in geo.assign(pts, rings, cell=cell, keep_unknown=False, refine=refine).collect()}
    assert known == {k: v[2] for k, v in want.items() if v[0] != "-1"}


@pytest.mark.parametrize("refine", ["ring", "bands", "quadtree"])
def test_holes_subtract(spark, rings, refine):
    pts = spark.createDataFrame([(1.5, 1.5), (0.5, 0.5)], "latitude double, longitude double")
    got = {(r.latitude, r.longitude): r.geo_county_name
           for r in geo.assign(pts, rings, holes="subtract", refine=refine).collect()}
    assert got == {(1.5, 1.5): "Unknown", (0.5, 0.5): "Holed"}
    inner = {(r.latitude, r.longitude): r.geo_county_name
             for r in geo.assign(pts, rings, holes="subtract", refine=refine, keep_unknown=False).collect()}
    assert inner == {(0.5, 0.5): "Holed"}


def test_attach_inner_and_left(spark, rings):
    w = spark.createDataFrame([(0.5, 0.5, 1), (0.5, 0.5, 2), (100.0, 100.0, 3), (None, 1.0, 4)],
                              "latitude double, longitude double, v int")
    m = geo.assign(w, rings)
    assert sorted(r.v for r in geo.attach(w, m).collect()) == [1, 2]
    left = {r.v: r.geo_state_code for r in geo.attach(w, m, keep_unknown=True).collect()}
    assert left == {1: "01", 2: "01", 3: "-1", 4: None}


def test_negative_zero_is_zero(spark, rings):
    w = spark.createDataFrame([(0.5, -0.0), (0.5, 0.0)], "latitude double, longitude double")
    assert geo.assign(w, rings).count() == 1


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

half = st.integers(min_value=0, max_value=40).map(lambda v: v / 4.0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(half, half, st.integers(1, 12).map(lambda v: v / 4.0), st.integers(1, 12).map(lambda v: v / 4.0)),
                min_size=1, max_size=5),
       st.lists(st.tuples(half, half), min_size=1, max_size=15))
def test_rectangles_are_half_open_first_wins(spark, rects, pts):
    """Axis-aligned rectangles: inside iff x0 <= lon < x1 and y0 <= lat < y1; first rectangle wins."""
    rows = []
    for i, (x0, y0, w, h) in enumerate(rects):
        ring = [[x0, y0], [x0 + w, y0], [x0 + w, y0 + h], [x0, y0 + h], [x0, y0]]
        rows.append((i, f"{i:02d}", "001", f"R{i}", 0, 0, ring, x0, y0, x0 + w, y0 + h))
    rings = spark.createDataFrame(rows, "ord long, state_code string, county_code string, county_name string, "
                                        "poly_no int, ring_no int, ring array<array<double>>, x0 double, y0 double, "
                                        "x1 double, y1 double")
    p = spark.createDataFrame([(float(y), float(x)) for x, y in pts], "latitude double, longitude double")
    got = {(r.latitude, r.longitude): r.geo_county_name for r in geo.assign(p, rings, cell=0.75).collect()}
    bands = {(r.latitude, r.longitude): r.geo_county_name
             for r in geo.assign(p, rings, cell=0.75, refine="bands").collect()}
    assert bands == got
    tree = {(r.latitude, r.longitude): r.geo_county_name for r in geo.assign(p, rings, refine="quadtree").collect()}
    assert tree == got
    for x, y in pts:
        want = "Unknown"
        for i, (x0, y0, w, h) in enumerate(rects):
            if x0 <= x < x0 + w and y0 <= y < y0 + h:
                want = f"R{i}"
                break
        assert got[(float(y), float(x))] == want


def test_auto_cell_handles_projected_units(spark):
    # rings in metres (50 km squares): a fixed 0.5 grid would explode into ~10^10 cells
    rows = []
    for i in range(4):
        x0, y0 = 500000.0 + i * 50000.0, 4000000.0
        ring = [[x0, y0], [x0 + 50000, y0], [x0 + 50000, y0 + 50000], [x0, y0 + 50000], [x0, y0]]
        rows.append((i, "01", f"{i:03d}", f"M{i}", 0, 0, ring, x0, y0, x0 + 50000, y0 + 50000))
    rings = spark.createDataFrame(rows, "ord long, state_code string, county_code string, county_name string, "
                                        "poly_no int, ring_no int, ring array<array<double>>, x0 double, y0 double, "
                                        "x1 double, y1 double")
    assert geo.cell_size(rings) == 50000.0
    pts = spark.createDataFrame([(4010000.0, 560000.0), (4010000.0, 499999.0)], "latitude double, longitude double")
    got = {r.longitude: r.geo_county_name for r in geo.assign(pts, rings).collect()}
    assert got == {560000.0: "M1", 499999.0: "Unknown"}


def test_line_delimited_features(spark, tmp_path):
    # same features, one per line, split over two files: same mapping as the collection
    d = tmp_path / "lines"
    d.mkdir()
    (d / "a.json").write_text("\n".join(json.dumps(f) for f in FEATURES[:3]) + "\n")
    (d / "b.json").write_text("\n".join(json.dumps(f) for f in FEATURES[3:]) + "\n")
    rings_l = read_county_rings(spark, str(d), lines=True)
    assert rings_l.count() == 7
    pts = spark.createDataFrame([(float(y), float(x)) for x, y in POINTS], "latitude double, longitude double")
    got = {(r.latitude, r.longitude): (r.geo_state_code, r.geo_county_code, r.geo_county_name)
           for r in geo.assign(pts, rings_l).collect()}
    assert got == {(float(y), float(x)): expected_county(x, y, FEATURES) for x, y in POINTS}


def test_bands_on_random_polygons(spark):
    import random
    rnd = random.Random(11)
    feats, rows = [], []
    for i in range(6):
        ring = [[rnd.uniform(0, 6), rnd.uniform(0, 6)] for _ in range(rnd.randint(5, 25))]
        ring.append(list(ring[0]))
        feats.append({"properties": {"STATEFP": "1", "COUNTYFP": str(i), "NAME": f"P{i}"},
                      "geometry": {"type": "Polygon", "coordinates": [ring]}})
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        rows.append((i, "01", f"{i:03d}", f"P{i}", 0, 0, ring, min(xs), min(ys), max(xs), max(ys)))
    rings = spark.createDataFrame(rows, "ord long, state_code string, county_code string, county_name string, "
                                        "poly_no int, ring_no int, ring array<array<double>>, x0 double, y0 double, "
                                        "x1 double, y1 double")
    pts = [(rnd.uniform(-0.5, 6.5), rnd.uniform(-0.5, 6.5)) for _ in range(300)]
    p = spark.createDataFrame([(y, x) for x, y in pts], "latitude double, longitude double")
    for cell in (0.3, 2.0):
        got = {(r.latitude, r.longitude): r.geo_county_name
               for r in geo.assign(p, rings, cell=cell, refine="bands").collect()}
        assert got == {(y, x): expected_county(x, y, feats)[2] for x, y in pts}
