"""Incremental ingestion of listings with Structured Streaming."""
