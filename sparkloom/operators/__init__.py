"""Operators: DataFrame in, DataFrame out, no hidden actions."""
