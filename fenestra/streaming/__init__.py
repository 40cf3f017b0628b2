"""Structured Streaming and incremental ingestion."""
