"""Spark-native profiling, cleaning, auditing and corpus preparation of large tables."""
