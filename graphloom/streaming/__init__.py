"""Incremental builds from a stream of landed extraction tables."""
