"""Inputs: CSV ingest, series files, literal dimensions, test-table mapping."""
