"""Sources of the radar engine."""
