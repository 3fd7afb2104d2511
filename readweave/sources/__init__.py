"""Sources of the read counting engine."""
