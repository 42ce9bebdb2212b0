"""Operators: profiling, cleaning, splitting, features, models, clustering,
evaluation and chart-ready tables."""
