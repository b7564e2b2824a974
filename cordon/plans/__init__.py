"""Plans as data."""
