"""Operators of a training-data pipeline: ten operators, their queries and SQL.

Nothing else in the library imports this subpackage.
"""
