"""Plans of the read counting engine."""
