"""Operators of the duplicate engine."""
