"""Incremental scans as streams."""
