"""Structured Streaming: the paper trader and bars from ticks."""
