"""functions of the association engine."""
