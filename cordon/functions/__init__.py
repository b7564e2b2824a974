"""Column functions and text analysis."""
