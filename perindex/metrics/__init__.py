"""Evaluation metrics as distributed aggregations."""
