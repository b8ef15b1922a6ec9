"""streaming of the association engine."""
