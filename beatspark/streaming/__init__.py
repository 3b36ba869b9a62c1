"""Streaming over beat tables."""
