"""Operators over training text: filtering, deduplication, mixing, encoding."""
