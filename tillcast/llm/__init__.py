"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it. Every operator takes DataFrames and
returns a DataFrame; the query registry is in ``queries.py``.
"""
