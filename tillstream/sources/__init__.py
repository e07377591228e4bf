"""Streams, change feeds and stored tables."""
