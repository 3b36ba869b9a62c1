"""Sources over beat tables."""
