"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the entry module adds its
queries when the subpackage is present.
"""
