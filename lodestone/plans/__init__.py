"""Whole scans: orchestration, payload, connectors and the command line."""
