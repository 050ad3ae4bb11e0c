"""Structured Streaming: sources, sinks and stateful queries."""
