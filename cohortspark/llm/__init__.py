"""Operators for large-scale training-data pipelines (self-contained)."""
