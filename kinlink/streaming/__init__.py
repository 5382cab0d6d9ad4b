"""streaming of the linkage engine."""
