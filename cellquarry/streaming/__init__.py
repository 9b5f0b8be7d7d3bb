"""Idempotent, resumable ingestion with Structured Streaming."""
