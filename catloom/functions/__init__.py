"""Scalar functions as native Column expressions (no Python on the executors)."""
