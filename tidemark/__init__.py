"""Tidemark: a Spark-first engine for time-series features and corpus work."""
