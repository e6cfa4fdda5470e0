"""Exposure analytics on Spark: ingest, extract, index, tag, search, report."""
