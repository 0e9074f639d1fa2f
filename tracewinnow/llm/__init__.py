"""Corpus operators for training-data pipelines.

Each module holds one operator with its own interface; ``queries`` holds the
thin registered queries.  Nothing outside this package imports it.
"""
