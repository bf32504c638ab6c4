"""Scans: landed CSV and JSON, batch-versioned lake datasets, reports."""
