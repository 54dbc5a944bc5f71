"""Structured Streaming: index upserts, debouncing, embedding."""
