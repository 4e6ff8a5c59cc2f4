"""Readers of files and of chunk tables."""
