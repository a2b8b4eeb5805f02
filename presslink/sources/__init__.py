"""Readers (ingest) and writers (sinks)."""
