"""Streams of documents into an index."""
