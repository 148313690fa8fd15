"""Operators on raw and typed events."""
