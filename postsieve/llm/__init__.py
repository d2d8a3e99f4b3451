"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Module `queries` registers one query per operator; `corpus_pipeline.py` at the repository top chains five of them.
"""
