"""Structured Streaming: incremental scoring of newly arrived files."""
