"""plans of the association engine."""
