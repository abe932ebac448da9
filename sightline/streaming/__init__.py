"""Structured Streaming pipelines and stateful operators."""
