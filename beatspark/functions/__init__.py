"""Functions over beat tables."""
