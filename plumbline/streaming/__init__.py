"""Incremental use of the operators with Structured Streaming."""
