"""Scans, sinks and declared schemas."""
