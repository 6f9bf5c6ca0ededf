"""Plans of the radar engine."""
