"""operators of the association engine."""
