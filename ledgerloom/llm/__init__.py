"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; ``queries.py`` applies each of them to its
whole table and derives the columns of the query contracts.
"""
