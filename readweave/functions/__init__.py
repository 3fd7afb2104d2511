"""Functions of the read counting engine."""
