"""Operators that prepare training data for language models.

Nothing outside this folder imports it. Every operator is a function from DataFrames to a
DataFrame; ``queries.py`` applies each one to its whole table.
"""
