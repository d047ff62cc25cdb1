"""Structured Streaming: capture, deep extraction and resume."""
