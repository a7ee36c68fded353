"""Inspection of data preparation and machine-learning pipelines on Spark."""
