"""Operators for preparing training text at scale: ten Spark jobs and their queries.

Nothing else in the library imports this subpackage.
"""
