"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the whole folder can be removed.
"""
