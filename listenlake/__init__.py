"""Listening-history analytics on Spark: ingest, dimensions, decayed play statistics, candidates, recommendations."""
