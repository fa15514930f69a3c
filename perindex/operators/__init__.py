"""Joins, windowing and pivots shared by the feature plans."""
