"""Whole scans, and the queries the driver runs."""
