"""Structured Streaming: continuous velocity, scoring, and monitoring."""
