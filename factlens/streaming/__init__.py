"""Incremental maintenance of facts with Structured Streaming."""
