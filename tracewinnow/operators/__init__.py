"""Operators over span tables."""
