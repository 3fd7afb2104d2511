"""Streaming of the read counting engine."""
