"""Sources of the feed engine."""
