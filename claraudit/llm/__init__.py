"""Operators for large-scale training-data pipelines, each built on Spark DataFrames.

Nothing outside this subpackage imports it.
"""
