"""Streaming of the radar engine."""
