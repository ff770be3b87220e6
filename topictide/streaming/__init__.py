"""Incremental ingestion with Structured Streaming."""

from topictide.streaming.ingest import ingest_days, read_ingested

__all__ = ["ingest_days", "read_ingested"]
