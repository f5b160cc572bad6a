"""Spark-native analytics for per-residue structure data, and corpus operators beside it."""
