"""Structured Streaming: ingest, claims, dated buckets."""
