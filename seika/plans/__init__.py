"""Parameter handling and the named query registry."""
