import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from yieldnorm.operators import enrich, quality

FIPS = "fips long, name string, state string"
ANOM = "id int, county string, state_abbr string, state string"


def test_join_and_normalisation(spark):
    fips = spark.createDataFrame([(17163, "St. Clair County", "IL"), (22057, "Lafourche Parish", "LA"),
                                  (17000, "Illinois", None), (99001, "Nowhere", "ZZ")], FIPS)
    anom = spark.createDataFrame([(1, " st. clair. ", "il", "Illinois"), (2, "\tLafourche\n", " la", "Louisiana"),
                                  (3, "Missing", "IL", "Illinois")], ANOM)
    out = {r.id: r.fips for r in enrich.anomalies_geo(anom, fips).collect()}
    assert out == {1: "17163", 2: "22057", 3: "00000"}
    rate = quality.match_rate(enrich.anomalies_enriched(anom, fips)).first()
    assert (rate.matched, rate.total) == (2, 3) and abs(rate.match_pct - 200 / 3) < 1e-9
    un = quality.unmatched(enrich.anomalies_enriched(anom, fips)).collect()
    assert [(r.state_abbr, r.county) for r in un] == [("IL", "MISSING")]


def test_null_county_matches_null(spark):
    fips = spark.createDataFrame([(1, None, "AA")], FIPS)  # name null -> county null
    anom = spark.createDataFrame([(1, None, "aa", "A")], ANOM)
    assert enrich.anomalies_geo(anom, fips).first().fips == "00001"  # T5: pandas merge matches null keys


def test_repeated_key_fans_out(spark):
    fips = spark.createDataFrame([(1, "X County", "AA"), (2, "X Parish", "AA")], FIPS)
    anom = spark.createDataFrame([(1, "x", "AA", "A")], ANOM)
    assert sorted(r.fips for r in enrich.anomalies_geo(anom, fips).collect()) == ["00001", "00002"]  # T9
    dup = enrich.duplicate_keys(enrich.clean_fips(fips)).first()
    assert (dup.county, dup.state_abbr, dup.n, dup.min_fips, dup.max_fips) == ("X", "AA", 2, 1, 2)


def test_summary_gets_abbr_from_anomalies(spark):
    fips = spark.createDataFrame([(5001, "Alpha County", "AL"), (6001, "Beta", "BE")], FIPS)
    anom = spark.createDataFrame([(1, "alpha", "al", "Alabama"), (2, "beta", "be", "Bet")], ANOM)
    summ = spark.createDataFrame([("Alabama", "Alpha.", 3), ("Bet", "beta", 1), ("Nowhere", "x", 2)],
                                 "state string, county string, n long")
    got = {r.state: (r.state_abbr, r.fips) for r in enrich.summary_geo(summ, anom, fips).collect()}
    assert got == {"Alabama": ("AL", "05001"), "Bet": ("BE", "06001"), "Nowhere": (None, "00000")}


def test_state_with_two_abbreviations_raises(spark):
    anom = spark.createDataFrame([(1, "a", "AL", "Alabama"), (2, "b", "AB", "Alabama")], ANOM)
    with pytest.raises((PySparkException, Py4JJavaError)):
        enrich.state_lookup(anom).collect()


def test_map_table(spark):
    df = spark.createDataFrame([("01001", 2020, 1.0), ("01001", 2020, 3.0), ("01003", 2021, 2.0)],
                               "fips string, year int, m double")
    got = {(r.fips, r.year): (r.sum_m, r.n_rows) for r in enrich.map_table(df, "m", "sum").collect()}
    assert got == {("01001", 2020): (4.0, 2), ("01003", 2021): (2.0, 1)}


def test_existing_state_abbr_is_replaced(spark):
    lookup = spark.createDataFrame([("Alabama", "AL")], "state string, state_abbr string")
    summ = spark.createDataFrame([("Alabama", "x", "ZZ")], "state string, county string, state_abbr string")
    out = enrich.with_state_abbr(summ, lookup)
    assert out.columns == ["state", "county", "state_abbr"] and out.first().state_abbr == "AL"
