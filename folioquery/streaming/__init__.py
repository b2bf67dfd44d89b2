"""Structured Streaming forms of the ingest stages."""
