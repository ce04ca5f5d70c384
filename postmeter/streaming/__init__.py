"""Streaming forms of volume operators."""
