"""Operators of the store."""
