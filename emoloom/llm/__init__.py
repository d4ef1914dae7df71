"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  ``queries`` lists the queries,
``oracles`` their SQL where SQL can express them.
"""
