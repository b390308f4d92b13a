"""Operators of a training-data pipeline over whole Spark tables.

Each module holds one operator with a general interface; ``queries`` holds the
thin registered queries and their SQL.  Nothing outside this folder and
``corpus_pipeline.py`` imports it.
"""
