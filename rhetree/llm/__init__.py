"""Operators for preparing training corpora.

Every operator takes and returns DataFrames. Nothing else in the library imports this
subpackage; `queries` holds the registered queries and their SQL.
"""
