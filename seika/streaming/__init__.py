"""Structured Streaming forms of the ingest and the monitoring snapshots."""
