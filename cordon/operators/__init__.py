"""Operators over tenant-scoped tables."""
