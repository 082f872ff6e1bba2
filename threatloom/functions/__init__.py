"""Functions of the feed engine."""
