"""Tail-based sampling of distributed traces as Spark plans."""
