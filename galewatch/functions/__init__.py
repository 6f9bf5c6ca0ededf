"""Functions of the radar engine."""
