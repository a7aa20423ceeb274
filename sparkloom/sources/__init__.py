"""Readers and writers of fields, telemetry, logs and weights."""
