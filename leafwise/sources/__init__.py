"""Scans, sinks and fixed dimension tables."""
