"""Spark-first reduction analytics for large geographic point tables."""
