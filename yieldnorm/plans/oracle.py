"""DuckDB twins of the registered queries (tables of the driver registered as views).

Each statement derives the inputs with the same rules as ``sources.fixtures`` and computes the
operator independently: point-in-polygon by unnesting ring edges and summing crossings, joins
and aggregates in plain SQL. Floating results are rounded to 6 decimals, as on the Spark side.
"""

from __future__ import annotations

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
MEASURES = ("precipitation", "temp_max", "temp_min", "snow_depth", "snowfall")
FEATURES = ("total_precipitation", "total_temp_max", "total_temp_min", "total_snow_depth", "total_snowfall",
            "observation_count")
AVG_MEASURES = tuple(f"avg_{m}" for m in MEASURES)

STATION = """station AS (
  SELECT s_suppkey,
         CASE WHEN s_suppkey % 29 = 0 THEN NULL ELSE CAST((s_suppkey * 17) % 54 AS DOUBLE) / 10 END AS latitude,
         CAST((s_suppkey * 37) % 56 AS DOUBLE) / 10 AS longitude
  FROM supplier)"""

WEATHER = """weather AS (
  SELECT st.latitude, st.longitude, CAST(l.l_shipdate AS DATE) AS date,
         CAST(floor(l.l_quantity) AS BIGINT) AS precipitation,
         CASE WHEN year(l.l_shipdate) % 3 = 0 THEN NULL ELSE CAST(floor(l.l_extendedprice) AS BIGINT) % 400 END AS temp_max,
         CASE WHEN year(l.l_shipdate) % 3 = 0 THEN NULL ELSE CAST(floor(l.l_extendedprice) AS BIGINT) % 300 - 100 END AS temp_min,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_linenumber AS BIGINT) END AS snow_depth,
         CASE WHEN l.l_linestatus = 'F' THEN CAST(l.l_linenumber AS BIGINT) * 2 END AS snowfall
  FROM lineitem l JOIN station st ON l.l_suppkey = st.s_suppkey)"""

# every county: the unit square at (k % 5, k // 5) with two corners cut, some wider, some with a hole or an island
RINGS = """shape AS (
  SELECT n.n_nationkey AS ord, 0 AS poly_no, 0 AS ring_no, v.i, 7 AS n_points,
         CAST(n.n_nationkey % 5 AS DOUBLE) + v.dx + CASE WHEN v.far AND n.n_nationkey % 6 = 1 THEN 0.35::DOUBLE ELSE 0 END AS x,
         CAST(n.n_nationkey // 5 AS DOUBLE) + v.dy AS y
  FROM nation n CROSS JOIN (VALUES (0, 0.25::DOUBLE, 0.0::DOUBLE, false), (1, 1.0::DOUBLE, 0.0::DOUBLE, true),
       (2, 1.0::DOUBLE, 0.75::DOUBLE, true), (3, 0.75::DOUBLE, 1.0::DOUBLE, true), (4, 0.0::DOUBLE, 1.0::DOUBLE, false),
       (5, 0.0::DOUBLE, 0.25::DOUBLE, false), (6, 0.25::DOUBLE, 0.0::DOUBLE, false)) v(i, dx, dy, far)
  UNION ALL
  SELECT n.n_nationkey, 0, 1, v.i, 5, CAST(n.n_nationkey % 5 AS DOUBLE) + v.dx, CAST(n.n_nationkey // 5 AS DOUBLE) + v.dy
  FROM nation n CROSS JOIN (VALUES (0, 0.25::DOUBLE, 0.25::DOUBLE), (1, 0.75::DOUBLE, 0.25::DOUBLE),
       (2, 0.75::DOUBLE, 0.75::DOUBLE), (3, 0.25::DOUBLE, 0.75::DOUBLE), (4, 0.25::DOUBLE, 0.25::DOUBLE)) v(i, dx, dy)
  WHERE n.n_nationkey % 3 = 1
  UNION ALL
  SELECT n.n_nationkey, 1, 0, v.i, 5, CAST(n.n_nationkey % 5 AS DOUBLE) + v.dx, v.y
  FROM nation n CROSS JOIN (VALUES (0, 0.25::DOUBLE, 5.05::DOUBLE), (1, 0.75::DOUBLE, 5.05::DOUBLE),
       (2, 0.75::DOUBLE, 5.35::DOUBLE), (3, 0.25::DOUBLE, 5.35::DOUBLE), (4, 0.25::DOUBLE, 5.05::DOUBLE)) v(i, dx, y)
  WHERE n.n_nationkey % 4 = 3)"""


def _geo(holes: str) -> str:
    """Mapping with a hole counted as inside (fill) or outside (subtract) of its polygon."""
    if holes == "fill":
        hits = "SELECT DISTINCT latitude, longitude, ord FROM in_ring"
    else:
        hits = ("SELECT DISTINCT latitude, longitude, ord FROM (SELECT latitude, longitude, ord, poly_no FROM in_ring "
                "GROUP BY ALL HAVING count(*) % 2 = 1)")
    return f"""pts AS (
  SELECT DISTINCT latitude, longitude FROM weather
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND NOT isnan(latitude) AND NOT isnan(longitude)),
{RINGS},
edges AS (
  SELECT a.ord, a.poly_no, a.ring_no, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj
  FROM shape a JOIN shape b ON a.ord = b.ord AND a.poly_no = b.poly_no AND a.ring_no = b.ring_no
   AND b.i = CASE WHEN a.i = 0 THEN a.n_points - 1 ELSE a.i - 1 END),
in_ring AS (
  SELECT p.latitude, p.longitude, e.ord, e.poly_no, e.ring_no
  FROM pts p CROSS JOIN edges e
  GROUP BY ALL
  HAVING sum(CASE WHEN ((e.yi > p.latitude) <> (e.yj > p.latitude))
                   AND (p.longitude < (e.xj - e.xi) * (p.latitude - e.yi) / NULLIF(e.yj - e.yi, 0) + e.xi)
                  THEN 1 ELSE 0 END) % 2 = 1),
hits AS ({hits}),
firsthit AS (SELECT latitude, longitude, min(ord) AS ord FROM hits GROUP BY latitude, longitude),
known_mapping AS (
  SELECT f.latitude, f.longitude, lpad(CAST(n.n_regionkey AS VARCHAR), 2, '0') AS geo_state_code,
         lpad(CAST(n.n_nationkey AS VARCHAR), 3, '0') AS geo_county_code, n.n_name AS geo_county_name
  FROM firsthit f JOIN nation n ON n.n_nationkey = f.ord),
mapping AS (
  SELECT p.latitude, p.longitude, coalesce(m.geo_state_code, '-1') AS geo_state_code,
         coalesce(m.geo_county_code, '-1') AS geo_county_code, coalesce(m.geo_county_name, 'Unknown') AS geo_county_name
  FROM pts p LEFT JOIN known_mapping m ON p.latitude = m.latitude AND p.longitude = m.longitude)"""


GEO = _geo("fill")


def _annual(stat: str) -> str:
    if stat == "sum":
        aggs = ",\n         ".join(f"CAST(sum(w.{m}) AS BIGINT) AS total_{m}" for m in MEASURES)
    else:
        aggs = ",\n         ".join(f"coalesce(avg(w.{m}), 0.0) AS avg_{m}" for m in MEASURES)
    return f"""annual_{stat} AS (
  SELECT m.geo_state_code, m.geo_county_code, m.geo_county_name, CAST(year(w.date) AS INTEGER) AS year,
         {aggs},
         CAST(count(*) AS BIGINT) AS observation_count
  FROM weather w JOIN known_mapping m ON w.latitude = m.latitude AND w.longitude = m.longitude
  GROUP BY ALL)"""


YIELDS = """yields AS (
  SELECT n.n_regionkey AS "State Code",
         'REGION_' || CAST(n.n_regionkey AS VARCHAR) AS "State Name",
         'R' || CAST(n.n_regionkey AS VARCHAR) AS "State Abbreviation",
         n.n_nationkey AS "County Code",
         '  ' || n.n_name || ' ' AS "County Name",
         CAST(year(o.o_orderdate) AS INTEGER) AS "Yield Year",
         CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c.c_mktsegment) AS INTEGER) AS "Commodity Code",
         CASE c.c_mktsegment WHEN 'BUILDING' THEN ' Corn' WHEN 'MACHINERY' THEN ' Soybeans' ELSE ' ' || c.c_mktsegment END AS "Commodity Name",
         o.o_orderstatus AS "Irrigation Practice Code",
         'practice ' || o.o_orderstatus AS "Irrigation Practice Name",
         CASE WHEN max(o.o_orderkey) % 11 = 0 THEN NULL ELSE CAST(max(o.o_orderkey % 2400) AS DOUBLE) / 10 END AS "Yield Amount"
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY ALL),
yields_prepared AS (
  SELECT "State Code", "State Name" AS state_name, "State Abbreviation" AS state_abbreviation, "County Code",
         "County Name", "Yield Year" AS yield_year, "Commodity Code" AS commodity_code,
         "Commodity Name" AS commodity_name, "Irrigation Practice Code" AS irrigation_practice_code,
         "Irrigation Practice Name" AS irrigation_practice_name, "Yield Amount" AS yield_amount,
         lpad(CAST("State Code" AS VARCHAR), 2, '0') AS state_code_padded,
         lpad(CAST("County Code" AS VARCHAR), 3, '0') AS county_code_padded,
         trim("County Name") AS county_name_trimmed
  FROM yields)"""


def _fact(stat: str) -> str:
    pre = "total" if stat == "sum" else "avg"
    ms = ", ".join(f"a.{pre}_{m}" for m in MEASURES)
    return f"""fact_{stat} AS (
  SELECT a.geo_state_code AS state_code, y.state_name, y.state_abbreviation, a.geo_county_code AS county_code,
         a.geo_county_name AS county_name, a.year, {ms}, a.observation_count,
         y.commodity_code, y.commodity_name, y.irrigation_practice_code, y.irrigation_practice_name, y.yield_amount
  FROM annual_{stat} a JOIN yields_prepared y
    ON a.geo_state_code = y.state_code_padded AND a.geo_county_code = y.county_code_padded
   AND a.geo_county_name = y.county_name_trimmed AND a.year = y.yield_year)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (STATION, WEATHER, GEO)
FACT_SUM = with_(*BASE, _annual("sum"), YIELDS, _fact("sum"))
FACT_AVG = with_(*BASE, _annual("avg"), YIELDS, _fact("avg"))


def r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


FACT_COLS_SUM = ("state_code, state_name, state_abbreviation, county_code, county_name, year, "
                 + ", ".join(f"total_{m}" for m in MEASURES)
                 + ", observation_count, commodity_code, commodity_name, irrigation_practice_code, "
                   "irrigation_practice_name, yield_amount")
FACT_COLS_AVG_ROUNDED = ("state_code, state_name, state_abbreviation, county_code, county_name, year, "
                         + ", ".join(r(f"avg_{m}", f"avg_{m}") for m in MEASURES)
                         + ", observation_count, commodity_code, commodity_name, irrigation_practice_code, "
                           "irrigation_practice_name, yield_amount")

# ---- linear baseline: least squares of yield on total_precipitation, per crop
LINEAR = FACT_SUM.rstrip("\n") + """,
labelled AS (SELECT * FROM fact_sum WHERE yield_amount IS NOT NULL),
coef AS (SELECT commodity_name, regr_slope(yield_amount, total_precipitation) AS slope,
                regr_intercept(yield_amount, total_precipitation) AS icpt
         FROM labelled GROUP BY commodity_name),
pred AS (
  SELECT l.state_code, l.county_code, l.year, l.commodity_name, l.irrigation_practice_code, l.yield_amount,
         c.icpt + c.slope * l.total_precipitation AS predicted_yield,
         l.yield_amount - (c.icpt + c.slope * l.total_precipitation) AS residual,
         """ + ", ".join(f"l.{f}" for f in FEATURES) + """
  FROM labelled l LEFT JOIN coef c ON l.commodity_name IS NOT DISTINCT FROM c.commodity_name)
"""
PRED_COLS = ("state_code, county_code, year, commodity_name, irrigation_practice_code, yield_amount, "
             "round(predicted_yield, 6) AS predicted_yield, round(residual, 6) AS residual, " + ", ".join(FEATURES))
PRED_ORDER_TIE = ("state_code, county_code, year, commodity_name, irrigation_practice_code, yield_amount, "
                  "predicted_yield, residual, " + ", ".join(FEATURES))


def _tie(cols: str) -> str:
    return ", ".join(f"{c.strip()} ASC NULLS LAST" for c in cols.split(","))


# ---- FIPS enrichment
ENRICH = with_("""fips AS (
  SELECT CAST(r.r_regionkey * 1000 + n.n_nationkey AS BIGINT) AS fips,
         n.n_name || CASE n.n_nationkey % 3 WHEN 0 THEN ' County' WHEN 1 THEN ' Parish' ELSE '' END AS name,
         substr(r.r_name, 1, 2) AS state
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 7 <> 0
  UNION ALL
  SELECT CAST(r.r_regionkey * 1000 + 500 + n.n_nationkey AS BIGINT) AS fips, lower(n.n_name) || ' county.' AS name,
         substr(r.r_name, 1, 2) AS state
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 11 = 5
  UNION ALL
  SELECT CAST(r_regionkey * 1000 AS BIGINT) AS fips, r_name AS name, CAST(NULL AS VARCHAR) AS state FROM region)""",
               f"""fips_clean AS (
  SELECT fips, name, state,
         trim(replace(replace(replace(upper(name), ' COUNTY', ''), ' PARISH', ''), '.', ''), {WS}) AS county,
         trim(upper(state), {WS}) AS state_abbr
  FROM fips WHERE state IS NOT NULL)""",
               """places AS (
  SELECT c.c_custkey, n.n_name, r.r_name
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE c.c_acctbal < 0)""",
               """anomalies AS (
  SELECT c_custkey, ' ' || lower(n_name) || '. ' AS county, lower(substr(r_name, 1, 2)) AS state_abbr,
         r_name AS state, CAST(1995 + c_custkey % 7 AS INTEGER) AS year
  FROM places)""",
               f"""anom_enriched AS (
  SELECT a.c_custkey, a.county, a.state_abbr, a.state, a.year, f.fips
  FROM (SELECT c_custkey, trim(replace(upper(county), '.', ''), {WS}) AS county,
               trim(upper(state_abbr), {WS}) AS state_abbr, state, year FROM anomalies) a
  LEFT JOIN fips_clean f ON a.county IS NOT DISTINCT FROM f.county AND a.state_abbr IS NOT DISTINCT FROM f.state_abbr)""",
               """anomalies_geo AS (
  SELECT c_custkey, county, state_abbr, state, year, lpad(CAST(coalesce(fips, 0) AS VARCHAR), 5, '0') AS fips
  FROM anom_enriched)""",
               """summary AS (
  SELECT r_name AS state, ' ' || lower(n_name) || '. ' AS county, CAST(count(*) AS BIGINT) AS n_anomalies
  FROM places GROUP BY ALL)""",
               """lookup AS (
  SELECT state, max(state_abbr) AS state_abbr FROM (SELECT DISTINCT state, state_abbr FROM anom_enriched) GROUP BY state)""",
               f"""summary_enriched AS (
  SELECT s.state, s.county, s.n_anomalies, l.state_abbr, f.fips
  FROM (SELECT state, trim(replace(upper(county), '.', ''), {WS}) AS county, n_anomalies FROM summary) s
  LEFT JOIN lookup l ON s.state IS NOT DISTINCT FROM l.state
  LEFT JOIN fips_clean f ON s.county IS NOT DISTINCT FROM f.county AND l.state_abbr IS NOT DISTINCT FROM f.state_abbr)""")

MAP_YEAR = 1997


def _pearson_sql(mode: str) -> str:
    parts = []
    for c in AVG_MEASURES:
        if mode == "zero":
            x, y, n = f"coalesce({c}, 0.0)", "coalesce(yield_amount, 0.0)", "count(*)"
        else:
            both = f"({c} IS NOT NULL AND yield_amount IS NOT NULL)"
            x = f"CASE WHEN {both} THEN {c} END"
            y = f"CASE WHEN {both} THEN yield_amount END"
            n = f"count(*) FILTER (WHERE {both})"
        parts.append(
            f"SELECT commodity_name, '{c}' AS measure, "
            f"round(covar_samp({x}, {y}) / NULLIF(stddev_samp({x}) * stddev_samp({y}), 0), 6) AS pearson, "
            f"CAST({n} AS BIGINT) AS n_pairs FROM fact_avg GROUP BY commodity_name")
    return FACT_AVG + "\nUNION ALL\n".join(parts)


def _zscore_cols(partition: str) -> str:
    out = []
    for c in AVG_MEASURES:
        over = f"OVER ({partition})"
        out.append(r(f"({c} - avg({c}) {over}) / NULLIF(stddev_samp({c}) {over}, 0)", f"{c}_normalized"))
    return ", ".join(out)


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src_weather"] = with_(STATION, WEATHER) + "SELECT * FROM weather"
    q["src_weather_checked"] = with_(STATION, WEATHER) + (
        "SELECT date, CAST(count(*) FILTER (WHERE bad IS NOT TRUE) AS BIGINT) AS n_good, "
        "CAST(sum(precipitation) FILTER (WHERE bad IS NOT TRUE) AS DOUBLE) AS precipitation, "
        "CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_bad FROM (SELECT *, temp_max % 50 = 7 AS bad FROM weather) GROUP BY date")
    q["src_yields"] = with_(YIELDS.split(",\nyields_prepared")[0]) + "SELECT * FROM yields"
    q["src_county_rings"] = with_(RINGS) + """SELECT CAST(s.ord AS BIGINT) AS ord, lpad(CAST(n.n_regionkey AS VARCHAR), 2, '0') AS state_code,
       lpad(CAST(n.n_nationkey AS VARCHAR), 3, '0') AS county_code, n.n_name AS county_name, s.poly_no, s.ring_no,
       s.n_points, min(s.x) AS x0, min(s.y) AS y0, max(s.x) AS x1, max(s.y) AS y1
FROM shape s JOIN nation n ON s.ord = n.n_nationkey
GROUP BY s.ord, n.n_regionkey, n.n_nationkey, n.n_name, s.poly_no, s.ring_no, s.n_points"""
    q["src_county_rings_file"] = q["src_county_rings"]
    # a line-delimited file carries no position: the feature's place is its file and line
    q["src_county_rings_lines"] = with_(RINGS) + """SELECT lpad(CAST(n.n_regionkey AS VARCHAR), 2, '0') AS state_code,
       lpad(CAST(n.n_nationkey AS VARCHAR), 3, '0') AS county_code, n.n_name AS county_name, s.poly_no, s.ring_no,
       s.n_points, min(s.x) AS x0, min(s.y) AS y0, max(s.x) AS x1, max(s.y) AS y1
FROM shape s JOIN nation n ON s.ord = n.n_nationkey
GROUP BY n.n_regionkey, n.n_nationkey, n.n_name, s.poly_no, s.ring_no, s.n_points"""
    q["src_fips"] = ENRICH + "SELECT fips, name, state FROM fips"
    q["src_fips_csv"] = q["src_fips"]
    q["src_anomalies"] = ENRICH + "SELECT * FROM anomalies"
    q["src_county_summary"] = ENRICH + "SELECT * FROM summary"

    q["geo_mapping"] = with_(*BASE) + "SELECT * FROM mapping"
    q["geo_mapping_subtract"] = with_(STATION, WEATHER, _geo("subtract")) + "SELECT * FROM mapping"
    q["geo_mapping_bands"] = q["geo_mapping"]
    q["geo_mapping_auto"] = q["geo_mapping"]
    q["geo_mapping_ring"] = q["geo_mapping"]
    q["geo_mapping_quadtree"] = q["geo_mapping"]
    q["geo_mapping_known"] = with_(*BASE) + "SELECT * FROM known_mapping"
    q["weather_with_county"] = with_(*BASE) + """SELECT w.latitude, w.longitude, w.date, w.precipitation, w.temp_max,
       w.temp_min, w.snow_depth, w.snowfall, m.geo_state_code, m.geo_county_code, m.geo_county_name,
       CAST(year(w.date) AS INTEGER) AS year
FROM weather w JOIN known_mapping m ON w.latitude = m.latitude AND w.longitude = m.longitude"""
    q["annual_sum"] = with_(*BASE, _annual("sum")) + "SELECT * FROM annual_sum"
    q["annual_sum_direct"] = q["annual_sum"]
    q["streaming_annual_sum"] = q["annual_sum"]
    q["annual_avg"] = with_(*BASE, _annual("avg")) + (
        "SELECT geo_state_code, geo_county_code, geo_county_name, year, "
        + ", ".join(r(f"avg_{m}", f"avg_{m}") for m in MEASURES) + ", observation_count FROM annual_avg")
    q["annual_avg_unfilled"] = with_(*BASE, _annual("avg").replace("coalesce(avg(w.", "(avg(w.").replace("), 0.0) AS avg_", ")) AS avg_")) + (
        "SELECT geo_state_code, geo_county_code, geo_county_name, year, "
        + ", ".join(r(f"avg_{m}", f"avg_{m}") for m in MEASURES) + ", observation_count FROM annual_avg")
    q["yields_prepared"] = with_(YIELDS) + "SELECT * FROM yields_prepared"
    q["fact_sum"] = FACT_SUM + "SELECT * FROM fact_sum"
    q["fact_avg"] = FACT_AVG + f"SELECT {FACT_COLS_AVG_ROUNDED} FROM fact_avg"
    q["fact_null_counts"] = FACT_SUM + "SELECT " + ", ".join(
        f"CAST(count(*) FILTER (WHERE {c.strip()} IS NULL) AS BIGINT) AS {c.strip()}" for c in FACT_COLS_SUM.split(",")
    ) + " FROM fact_sum"
    q["fact_row_count"] = FACT_SUM + "SELECT CAST(count(*) AS BIGINT) AS row_count FROM fact_sum"
    first = ["state_code", "county_code", "year", "commodity_code", "irrigation_practice_code"]
    order = first + [c.strip() for c in FACT_COLS_SUM.split(",") if c.strip() not in first]
    q["fact_preview"] = FACT_SUM + ("SELECT * FROM fact_sum ORDER BY "
                                    + ", ".join(f"{c} ASC NULLS FIRST" for c in order) + " LIMIT 20")
    q["annual_sum_years"] = with_(*BASE, _annual("sum").replace(
        "GROUP BY ALL", "WHERE w.date >= DATE '1996-01-01' AND w.date < DATE '2001-01-01'\n  GROUP BY ALL")) + \
        "SELECT * FROM annual_sum"
    q["fact_years"] = FACT_SUM + "SELECT * FROM fact_sum WHERE year BETWEEN 1996 AND 2000"

    q["crop_moments"] = FACT_AVG + "SELECT commodity_name, " + ", ".join(
        f"{r(f'avg({c})', c + '_mean')}, {r(f'stddev_samp({c})', c + '_stddev')}" for c in AVG_MEASURES
    ) + " FROM fact_avg GROUP BY commodity_name"
    q["crop_zscore"] = FACT_AVG + f"SELECT {FACT_COLS_AVG_ROUNDED}, {_zscore_cols('PARTITION BY commodity_name')} FROM fact_avg"
    q["corn_zscore"] = FACT_AVG + (f"SELECT {FACT_COLS_AVG_ROUNDED}, {_zscore_cols('')} FROM fact_avg "
                                   "WHERE commodity_name = ' Corn'")
    q["pearson"] = _pearson_sql("zero")
    q["pearson_pairwise"] = _pearson_sql("pairwise")

    ml_select = ("state_code, county_code, year, commodity_name, irrigation_practice_code, yield_amount, "
                 + ", ".join(f"coalesce({f}, 0) AS {f}" for f in FEATURES))
    q["ml_table"] = FACT_SUM + (f"SELECT {ml_select} FROM fact_sum "
                                "WHERE trim(commodity_name) = 'Corn' AND yield_amount IS NOT NULL")
    fm = []
    for f in FEATURES:
        if f in ("total_temp_max", "total_temp_min"):
            fm.append(r(f"coalesce(CAST({f} AS DOUBLE), avg({f}) OVER ())", f))
        else:
            fm.append(f)
    q["ml_fill_mean"] = FACT_SUM + ("SELECT state_code, county_code, year, commodity_name, yield_amount, "
                                    + ", ".join(fm) + " FROM fact_sum "
                                    "WHERE trim(commodity_name) = 'Corn' AND yield_amount IS NOT NULL")

    q["linear_predictions"] = LINEAR + f"SELECT {PRED_COLS} FROM pred"
    q["top50_abs_residual"] = LINEAR + (f"SELECT {PRED_COLS} FROM pred ORDER BY abs(residual) DESC NULLS LAST, "
                                        f"{_tie(PRED_ORDER_TIE)} LIMIT 50")
    q["underperformers"] = LINEAR + (f"SELECT {PRED_COLS} FROM pred ORDER BY residual ASC NULLS LAST, "
                                     f"{_tie(PRED_ORDER_TIE)} LIMIT 20")
    q["overperformers"] = LINEAR + (f"SELECT {PRED_COLS} FROM pred ORDER BY residual DESC NULLS LAST, "
                                    f"{_tie(PRED_ORDER_TIE)} LIMIT 20")
    q["top5_abs_residual_by_crop"] = LINEAR + (
        f"SELECT * FROM (SELECT {PRED_COLS}, CAST(row_number() OVER (PARTITION BY commodity_name "
        f"ORDER BY abs(residual) DESC NULLS LAST, {_tie(PRED_ORDER_TIE)}) AS INTEGER) AS rank FROM pred) WHERE rank <= 5")
    q["linear_metrics"] = LINEAR + (
        "SELECT commodity_name, CAST(count(*) AS BIGINT) AS n, "
        "round(sqrt(avg((yield_amount - predicted_yield) * (yield_amount - predicted_yield))), 6) AS rmse, "
        "round(1.0 - avg((yield_amount - predicted_yield) * (yield_amount - predicted_yield)) "
        "/ NULLIF(var_pop(yield_amount), 0), 6) AS r2 FROM pred GROUP BY commodity_name")
    q["residual_class"] = LINEAR + (
        f"SELECT {PRED_COLS}, CASE WHEN residual > 5.0 THEN 'outperform' WHEN residual < -5.0 THEN 'underperform' "
        "WHEN residual IS NOT NULL THEN 'aligned' END AS performance FROM pred")
    # one residual per county, crop and year (the mean over irrigation practices), then a county's years
    by_year = (LINEAR.rstrip("\n") + ",\nby_year AS (SELECT state_code, county_code, commodity_name, year, avg(residual) AS res "
               "FROM pred GROUP BY ALL),\n"
               "steady AS (SELECT state_code, county_code, commodity_name, count(DISTINCT year) FILTER (WHERE res IS NOT NULL) AS n_years, "
               "avg(res) AS mean_residual, stddev_samp(res) AS stddev_residual, "
               "CAST(count(*) FILTER (WHERE res > 0) AS DOUBLE) / NULLIF(count(res), 0) AS share_positive, "
               "min(res) AS min_residual, max(res) AS max_residual FROM by_year GROUP BY ALL)\n")
    cols = ("state_code, county_code, commodity_name, n_years, round(mean_residual, 6) AS mean_residual, "
            "round(stddev_residual, 6) AS stddev_residual, round(share_positive, 6) AS share_positive, "
            "round(min_residual, 6) AS min_residual, round(max_residual, 6) AS max_residual")
    q["residual_consistency"] = by_year + f"SELECT {cols} FROM steady"
    q["residual_patterns"] = by_year + (
        f"SELECT {cols}, CASE WHEN share_positive >= 0.75 THEN 'consistent outperformer' WHEN share_positive <= 0.25 "
        "THEN 'consistent underperformer' WHEN share_positive IS NOT NULL THEN 'mixed' END AS pattern FROM steady")
    # chances of at least k of n signs, term by term from log-gamma
    def tail(k):
        return (f"(SELECT coalesce(sum(exp(lgamma(n_signed + 1) - lgamma(i + 1) - lgamma(n_signed - i + 1) - n_signed * ln(2))), 0) "
                f"FROM range(0, 1000) t(i) WHERE i >= {k} AND i <= n_signed)")

    q["residual_sign_test"] = by_year.rstrip("\n") + (
        ",\nsigns AS (SELECT state_code, county_code, commodity_name, CAST(count(*) FILTER (WHERE res <> 0) AS BIGINT) AS n_signed, "
        "CAST(count(*) FILTER (WHERE res > 0) AS BIGINT) AS n_above FROM by_year GROUP BY ALL),\n"
        f"tails AS (SELECT *, {tail('n_above')} AS p_above, {tail('n_signed - n_above')} AS p_below FROM signs)\n"
        "SELECT state_code, county_code, commodity_name, n_signed, n_above, round(p_above, 9) AS p_above, round(p_below, 9) AS p_below, "
        "CASE WHEN p_above <= 0.15 THEN 'consistent outperformer' WHEN p_below <= 0.15 THEN 'consistent underperformer' "
        "ELSE 'not shown' END AS pattern FROM tails")
    q["fips_clean"] = ENRICH + "SELECT * FROM fips_clean"
    q["fips_duplicates"] = ENRICH + ("SELECT county, state_abbr, CAST(count(*) AS BIGINT) AS n FROM fips_clean "
                                     "GROUP BY county, state_abbr HAVING count(*) > 1")
    q["anomalies_geo"] = ENRICH + "SELECT * FROM anomalies_geo"
    rate = ("SELECT CAST(count(fips) AS BIGINT) AS matched, CAST(count(*) AS BIGINT) AS total, "
            "round(CAST(count(fips) AS DOUBLE) * 100.0 / NULLIF(count(*), 0), 6) AS match_pct FROM ")
    q["anomalies_match_rate"] = ENRICH + rate + "anom_enriched"
    q["anomalies_unmatched"] = ENRICH + "SELECT DISTINCT state_abbr, county FROM anom_enriched WHERE fips IS NULL"
    q["state_lookup"] = ENRICH + "SELECT * FROM lookup"
    q["county_summary_geo"] = ENRICH + ("SELECT state, county, n_anomalies, state_abbr, "
                                        "lpad(CAST(coalesce(fips, 0) AS VARCHAR), 5, '0') AS fips FROM summary_enriched")
    q["summary_match_rate"] = ENRICH + rate + "summary_enriched"
    # only rows with a FIPS code belong to a county; the others are reported by anomalies_unmatched
    code = "lpad(CAST(fips AS VARCHAR), 5, '0')"
    q["anomaly_map"] = ENRICH + (f"SELECT {code} AS fips, year, CAST(count(*) AS BIGINT) AS n_rows FROM anom_enriched "
                                 "WHERE fips IS NOT NULL GROUP BY ALL")
    q["anomaly_map_year"] = ENRICH + (f"SELECT {code} AS fips, year, CAST(count(*) AS BIGINT) AS n_rows FROM anom_enriched "
                                      f"WHERE fips IS NOT NULL AND year = {MAP_YEAR} GROUP BY ALL")
    q["top10_counties"] = ENRICH + (f"SELECT {code} AS fips, CAST(count(c_custkey) AS BIGINT) AS count_c_custkey "
                                    "FROM anom_enriched WHERE fips IS NOT NULL GROUP BY ALL "
                                    "ORDER BY count_c_custkey DESC, fips ASC LIMIT 10")

    # ---- boosted trees: what must hold of any fit, from the data
    corn = FACT_SUM.rstrip("\n") + ",\ncorn AS (SELECT * FROM fact_sum WHERE trim(commodity_name) = 'Corn' AND yield_amount IS NOT NULL)\n"
    keys = "state_code, county_code, year, commodity_name, irrigation_practice_code, round(yield_amount, 6) AS yield_amount"
    q["gbt_prediction_rows"] = corn + f"SELECT {keys}, true AS predicted, true AS residual_is_difference FROM corn"
    q["gbt_by_crop_rows"] = FACT_SUM + (f"SELECT {keys}, true AS predicted, true AS residual_is_difference FROM fact_sum "
                                        "WHERE yield_amount IS NOT NULL")
    q["gbt_tree_scores"] = corn + f"SELECT {keys}, true AS scores_equal FROM corn"
    q["gbt_first_leaves"] = corn + ("SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS leaves_are_means, "
                                    "round(CAST(sum(yield_amount) AS DOUBLE), 6) AS total_yield FROM corn")
    q["gbt_prefix_rmse"] = corn + ("SELECT CAST(k AS INTEGER) AS maxIter, count(*) AS n, true AS rmse_equals_grid "
                                   "FROM corn CROSS JOIN (VALUES (50), (100)) AS its(k) GROUP BY k")
    q["gbt_importance_sum"] = "SELECT CAST(6 AS BIGINT) AS n_features, true AS all_between_0_and_1, CAST(1.0 AS DOUBLE) AS total"
    q["gbt_grid_points"] = """SELECT CAST(row_number() OVER (ORDER BY a.i, d.i, s.i) - 1 AS INTEGER) AS grid_pos, a.v AS maxIter,
       d.v AS maxDepth, s.v AS stepSize, true AS rmse_not_above_fewer_trees
FROM (VALUES (0, 50), (1, 100), (2, 200)) a(i, v) CROSS JOIN (VALUES (0, 3), (1, 5), (2, 7)) d(i, v)
CROSS JOIN (VALUES (0, 0.05::DOUBLE), (1, 0.1::DOUBLE), (2, 0.2::DOUBLE)) s(i, v)"""
    q["gbt_best_is_least"] = "SELECT CAST(1 AS BIGINT) AS n_best, true AS least_rmse"

    # ---- sinks: written, read back
    q["sink_table"] = q["fact_sum"]
    q["sink_table_replaced"] = q["county_summary_geo"]
    q["sink_parquet"] = q["fact_years"]
    return q
