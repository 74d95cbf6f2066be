"""Streaming of the duplicate engine."""
