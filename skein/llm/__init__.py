"""Operators for large-scale training-data pipelines. Nothing outside this sub-package imports it."""
