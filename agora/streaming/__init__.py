"""Structured Streaming jobs (validated ingest, continuous monthly revenue)."""
