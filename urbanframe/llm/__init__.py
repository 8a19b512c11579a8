"""Operators of a text pipeline: duplicates, licences, classifiers, tokens, neighbours, packing.

Every operator takes and returns DataFrames; ``queries`` holds the registered
queries with their SQL. Nothing outside this package imports it.
"""
