"""The FIPS enrichment against pandas, the library of the original notebook, on random inputs."""

import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from yieldnorm.operators import enrich

ALPHABET = "ab. \tCOUNTYPARISHcountyXy"
names = st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=12))
abbrs = st.one_of(st.none(), st.sampled_from(["al", " AL", "ak\t", "AK", "zz"]))


def norm_key(value, drop_suffixes=False):
    """Upper-case, optionally drop ' COUNTY' / ' PARISH', drop dots, strip white space."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    out = value.upper()
    for suffix in (" COUNTY", " PARISH") if drop_suffixes else ():
        out = out.replace(suffix, "")
    return out.replace(".", "").strip()


def expected_fips_keys(fips_pd):
    kept = fips_pd[fips_pd["state"].notna()].copy()
    kept["county"] = kept["name"].map(lambda v: norm_key(v, drop_suffixes=True))
    kept["state_abbr"] = kept["state"].map(lambda v: v.upper().strip())
    return kept[["county", "state_abbr", "fips"]]


def expected_data_keys(data_pd):
    out = data_pd.copy()
    out["county"] = out["county"].map(norm_key)
    out["state_abbr"] = out["state_abbr"].map(lambda v: None if v is None else v.upper().strip())
    return out


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return int(v)
    return v


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(names, abbrs), min_size=1, max_size=6), st.lists(st.tuples(names, abbrs), min_size=1, max_size=6))
def test_with_fips_matches_pandas_merge(spark, fips_rows, data_rows):
    fips_pd = pd.DataFrame([(1000 + i, n, s) for i, (n, s) in enumerate(fips_rows)], columns=["fips", "name", "state"])
    data_pd = pd.DataFrame([(i, n, s) for i, (n, s) in enumerate(data_rows)], columns=["id", "county", "state_abbr"])
    # pandas' left merge is the behaviour to match (it pairs missing keys with missing keys)
    want = pd.merge(expected_data_keys(data_pd), expected_fips_keys(fips_pd), on=["county", "state_abbr"], how="left")
    want_rows = sorted((int(r.id), canon(r.county), canon(r.state_abbr), canon(r.fips)) for r in want.itertuples())

    fips_df = spark.createDataFrame([tuple(x) for x in fips_pd.astype(object).itertuples(index=False)],
                                    "fips long, name string, state string")
    data_df = spark.createDataFrame([tuple(x) for x in data_pd.astype(object).itertuples(index=False)],
                                    "id long, county string, state_abbr string")
    got = enrich.with_fips(enrich.normalize_places(data_df), enrich.clean_fips(fips_df)).collect()
    got_rows = sorted((r.id, r.county, r.state_abbr, r.fips) for r in got)
    assert got_rows == want_rows
