"""Scans of logical tables, dataset readers and sinks."""
