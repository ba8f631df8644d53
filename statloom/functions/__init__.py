"""Part of the statistics engine."""
