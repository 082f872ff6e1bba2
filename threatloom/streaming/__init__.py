"""Streaming of the feed engine."""
