"""Spark-first analytics over per-user, time-ordered sensor and activity streams."""
