"""Streaming forms of the stateless steps."""
