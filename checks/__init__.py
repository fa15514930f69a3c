"""Checks of the Spark results against an independent SQL engine."""
