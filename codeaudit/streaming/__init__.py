"""Incremental forms of the scan."""
