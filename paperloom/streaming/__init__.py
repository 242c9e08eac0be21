"""Structured Streaming: quiet-period batches and exactly-once runs."""
