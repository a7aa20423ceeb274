"""Adaptive array analytics on Spark: chunk statistics, encoding choice, quality and telemetry queries."""
