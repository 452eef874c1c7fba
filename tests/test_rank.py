from yieldnorm.operators import rank

SCHEMA = "state_code string, county_code string, year int, commodity_name string, residual double"
ROWS = [("01", "001", 2020, "Corn", -5.0), ("01", "002", 2020, "Corn", 5.0), ("01", "003", 2020, "Corn", 1.0),
        ("02", "001", 2021, "Corn", -5.0), ("01", "001", 2021, "Soy", 0.2), ("01", "002", 2021, "Soy", None),
        ("01", "004", 2021, "Soy", -3.0)]


def test_largest_abs_with_key_ties(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [(r.state_code, r.county_code, r.residual) for r in rank.largest_abs(df, 3).collect()]
    assert got == [("01", "001", -5.0), ("01", "002", 5.0), ("02", "001", -5.0)]


def test_under_over(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [r.residual for r in rank.underperformers(df, 2).collect()] == [-5.0, -5.0]
    assert [r.residual for r in rank.overperformers(df, 3).collect()] == [5.0, 1.0, 0.2]


def test_top_per_group(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r.commodity_name, r.rank, r.residual) for r in rank.largest_abs(df, 1, by=["commodity_name"]).collect())
    assert got == [("Corn", 1, -5.0), ("Soy", 1, -3.0)]


def test_classify_and_consistency(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cls = {(r.county_code, r.year, r.commodity_name): r.performance for r in rank.classify(df, tol=0.5).collect()}
    assert cls[("001", 2020, "Corn")] == "underperform" and cls[("002", 2020, "Corn")] == "outperform"
    assert cls[("001", 2021, "Soy")] == "aligned" and cls[("002", 2021, "Soy")] is None
    c = {(r.state_code, r.county_code, r.commodity_name): r for r in rank.consistency(df).collect()}
    assert c[("01", "001", "Corn")].n_years == 1 and c[("01", "002", "Soy")].n_years == 0
    assert c[("01", "002", "Soy")].share_positive is None


def test_for_year_and_top_counties(spark):
    df = spark.createDataFrame([("a", 2020, 1.0), ("a", 2021, 5.0), ("b", 2020, 4.0), ("c", 2020, 4.0)],
                               "fips string, year int, m double")
    assert rank.for_year(df, 2020).count() == 3
    top = [(r.fips, r.sum_m) for r in rank.top_counties(df, "m", 2).collect()]
    assert top == [("a", 6.0), ("b", 4.0)]


def test_consistency_patterns(spark):
    rows = [("01", "001", y, "Corn", r) for y, r in zip(range(4), (1.0, 2.0, 3.0, -1.0))] + \
           [("01", "002", y, "Corn", r) for y, r in zip(range(4), (-1.0, -2.0, -3.0, -4.0))] + \
           [("01", "003", y, "Corn", r) for y, r in zip(range(2), (1.0, -1.0))] + [("01", "004", 0, "Corn", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.county_code: r.pattern for r in rank.consistency(df, threshold=0.75).collect()}
    assert got == {"001": "consistent outperformer", "002": "consistent underperformer", "003": "mixed", "004": None}
    assert "pattern" not in rank.consistency(df).columns


def test_half_tail_equals_sums_of_binomials(spark):
    from math import comb

    from pyspark.sql import functions as F

    from yieldnorm.functions.binomial import half_tail
    cases = [(n, k) for n in (0, 1, 2, 7, 30) for k in range(-1, n + 2)] + [(3000, 1500), (3000, 1600), (None, 1), (3, None), (-1, 0)]
    got = spark.createDataFrame(cases, "n long, k long").withColumn("p", half_tail(F.col("n"), F.col("k"))).collect()
    for r in got:
        if r.n is None or r.k is None or r.n < 0:
            assert r.p is None
        else:
            want = sum(comb(r.n, i) for i in range(max(r.k, 0), r.n + 1)) / 2 ** r.n
            assert abs(r.p - want) < 1e-9


def test_sign_test(spark):
    rows = ([("up", y, 1.0 + y % 3) for y in range(6)] + [("down", y, -0.5) for y in range(9)] + [("two", y, 3.0) for y in range(2)]
            + [("mixed", y, (-1.0) ** y) for y in range(8)] + [("none", 1, None), ("none", 2, 0.0), ("none", 3, float("nan"))]
            + [("up", 0, 5.0), ("up", 1, -1.0)])  # further practices of a year: the mean's sign counts once
    got = {r.g: r for r in rank.sign_test(spark.createDataFrame(rows, "g string, year int, residual double"), by=["g"]).collect()}
    assert (got["up"].n_signed, got["up"].n_above, got["up"].pattern) == (6, 6, "consistent outperformer")
    assert abs(got["up"].p_above - 1 / 64) < 1e-12 and got["up"].p_below == 1.0
    assert (got["down"].n_above, got["down"].pattern) == (0, "consistent underperformer")
    assert got["two"].pattern == got["mixed"].pattern == got["none"].pattern == "not shown"
    assert (got["none"].n_signed, got["none"].p_above, got["none"].p_below) == (0, 1.0, 1.0)
