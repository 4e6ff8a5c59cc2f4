"""Composite plans, and the queries with their SQL."""
