"""Plans of the point-cloud engine."""
