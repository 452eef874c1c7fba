"""County yields prepared for the join with annual weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import pad_fips

# Report column -> snake-case name.
RENAMES = {
    "Yield Year": "yield_year",
    "Yield Amount": "yield_amount",
    "Commodity Code": "commodity_code",
    "Commodity Name": "commodity_name",
    "State Name": "state_name",
    "State Abbreviation": "state_abbreviation",
    "Irrigation Practice Code": "irrigation_practice_code",
    "Irrigation Practice Name": "irrigation_practice_name",
}


def prepare(df: DataFrame) -> DataFrame:
    """Add zero-padded state (2) and county (3) codes and a blank-trimmed county name, then
    rename the report columns to snake case (in place)."""
    out = df.withColumns({
        "state_code_padded": pad_fips(F.col("`State Code`"), 2),
        "county_code_padded": pad_fips(F.col("`County Code`"), 3),
        "county_name_trimmed": F.trim(F.col("`County Name`")),
    })
    return out.withColumnsRenamed(RENAMES)
