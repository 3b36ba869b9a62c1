"""Plans over beat tables."""
