"""Operators for training-data pipelines.

Each module holds one operator with its own interface; ``queries`` holds the
registered queries that apply them to whole tables.  Nothing outside this
subpackage imports it.
"""
