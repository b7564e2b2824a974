"""Tenant-scoped document analytics on Spark."""
