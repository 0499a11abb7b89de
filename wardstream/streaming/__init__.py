"""Structured Streaming twins of batch operators (an extension)."""
