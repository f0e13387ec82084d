"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; its queries are in ``queries.py``.
"""
