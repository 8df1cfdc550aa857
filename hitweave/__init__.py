"""Spark-first analytics for time-stamped detector hit streams."""
