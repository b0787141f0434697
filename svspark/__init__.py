"""Structural-variant analytics on PySpark DataFrames."""
