"""Operators of the radar engine."""
