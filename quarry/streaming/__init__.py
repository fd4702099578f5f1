"""Structured Streaming forms of the incremental parts."""
