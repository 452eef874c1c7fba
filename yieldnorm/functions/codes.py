"""Column helpers for FIPS codes and county / state names.

All are built-in Spark expressions (JVM side, whole-stage codegen), no Python UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space set removed by Python's str.strip() for ASCII text, and the
# suffixes dropped from FIPS-list county names.
ASCII_WHITESPACE = " \t\n\r\x0b\x0c"
COUNTY_SUFFIXES = (" COUNTY", " PARISH")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_fips(c: Column | str, width: int) -> Column:
    """Cast to string and left-pad with zeros to ``width`` (Spark ``lpad``: longer input is cut)."""
    return F.lpad(_c(c).cast("string"), width, "0")


def zfill(c: Column | str, width: int) -> Column:
    """Python ``str.zfill``: pad with zeros after an optional sign, never truncate."""
    s = _c(c).cast("string")
    signed = s.startswith("-") | s.startswith("+")
    return (
        F.when(F.length(s) >= width, s)
        .when(signed, F.concat(F.substring(s, 1, 1), F.lpad(F.substring(s, 2, 1 << 30), width - 1, "0")))
        .otherwise(F.lpad(s, width, "0"))
    )


def first_key(map_col: Column | str, keys: Sequence[str], default: str | None) -> Column:
    """First present, non-null value among ``keys`` of a string map, else ``default``."""
    m = _c(map_col)
    vals = [m.getItem(k) for k in keys]
    if default is not None:
        vals.append(F.lit(default))
    return F.coalesce(*vals) if len(vals) > 1 else vals[0]


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing white space (blanks, tabs, line breaks), like ``str.strip()``."""
    return F.btrim(_c(c), F.lit(ASCII_WHITESPACE))


def norm_county(c: Column | str, strip_suffix: bool = True) -> Column:
    """Upper-case, optionally drop ' COUNTY' / ' PARISH', drop '.', strip white space.

    Replacements are literal and hit every occurrence, in this order.
    """
    s = F.upper(_c(c))
    if strip_suffix:
        for suffix in COUNTY_SUFFIXES:
            s = F.replace(s, F.lit(suffix), F.lit(""))
    s = F.replace(s, F.lit("."), F.lit(""))
    return strip_ws(s)


def norm_abbr(c: Column | str) -> Column:
    """State abbreviation: upper-case and strip."""
    return strip_ws(F.upper(_c(c)))


def fips5(c: Column | str) -> Column:
    """FIPS as a 5-character string; null becomes '00000' (the unmatched marker)."""
    return zfill(F.coalesce(_c(c).cast("long"), F.lit(0)), 5)
