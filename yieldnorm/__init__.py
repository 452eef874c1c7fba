"""yieldnorm: weather-adjusted crop-yield analytics as plain Spark DataFrame code.

Sub-packages:
  sources/    readers and the test-table derivations (FIXTURES.md)
  functions/  Column-level helpers (code padding, name normalisation, ring parity)
  operators/  DataFrame -> DataFrame operators (geo join, annual weather, fact join,
              statistics, ranking, FIPS enrichment, data quality, models)
  plans/      end-to-end flows, the three analyses, and the query registry used by __spark_entry__
  streaming/  incremental annual weather over a stream of observation files
"""

__version__ = "0.1.0"
