"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every module holds one operator with
its own general interface; ``queries`` holds the thin registered queries.
"""
