"""Structured Streaming over the events: additions of this engine to batch queries of the same meaning."""
