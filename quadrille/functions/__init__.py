"""Closed-form geometry as Column expressions."""
