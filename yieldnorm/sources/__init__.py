from . import fixtures
from .fips import FIPS_SCHEMA, read_fips
from .geojson import county_rings, read_county_rings, read_feature_lines, read_features
from .tables import anomalies, county_summary, load, weather, yields

__all__ = ["fixtures", "FIPS_SCHEMA", "read_fips", "county_rings", "read_county_rings", "read_feature_lines", "read_features",
           "anomalies", "county_summary", "load", "weather", "yields"]
