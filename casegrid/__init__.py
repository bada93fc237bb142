"""casegrid: regional case analytics as Spark DataFrame plans.

Sub-packages:
  functions/  column helpers (rounding, safe division, bands, filters)
  operators/  composite DataFrame -> DataFrame metrics and join helpers
  sources/    CSV ingest, series files, literal dimensions, test-table mapping
  plans/      reports, the daily summary table, catalog and sinks
  streaming/  incremental ingest of landed extract files
"""

__version__ = "0.1.0"
