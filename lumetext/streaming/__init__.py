"""Structured Streaming: an index that follows its corpus."""
