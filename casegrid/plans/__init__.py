"""Report plans, the daily table, catalog and sinks."""
