"""Skew-aware stream and table joins on Spark."""
