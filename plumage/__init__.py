"""Spark-first engine for visual re-identification tables and vector analytics."""
