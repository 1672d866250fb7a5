"""Incremental forms of the plans on Structured Streaming."""
