"""Incremental refresh and keyed chat state with Structured Streaming."""
