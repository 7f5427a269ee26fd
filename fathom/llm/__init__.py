"""Training-data operators over a ``documents`` table.

Every operator takes DataFrames and returns DataFrames; ``queries.py`` holds
the thin registered queries and their SQL.  Nothing else in the package
imports this subpackage.
"""
