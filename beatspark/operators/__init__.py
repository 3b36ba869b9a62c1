"""Operators over beat tables."""
