"""Operators of the read counting engine."""
