"""Append-only arrival of photos."""
