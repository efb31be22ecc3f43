"""Operators for preparing training text, each a function from DataFrames to DataFrames.

Nothing outside this folder imports it. ``queries`` applies each operator to the whole of its table.
"""
