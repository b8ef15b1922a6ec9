"""sources of the association engine."""
