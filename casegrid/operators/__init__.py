"""Composite metrics and join helpers."""
