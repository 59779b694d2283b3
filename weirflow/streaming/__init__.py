"""Structured Streaming runners around the batch operators."""
