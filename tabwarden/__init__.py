"""Tabular audit and model evaluation on Spark."""
