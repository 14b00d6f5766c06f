"""Spark operators: profiling, labels, features, splits, metrics, models, search."""
