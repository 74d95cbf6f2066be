"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries.QUERIES`` and
``queries.ORACLE_SQL`` are what the entry module picks up.
"""
