"""Structured Streaming form of the answer validation log."""
