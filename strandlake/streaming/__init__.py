"""Searching reads as they arrive."""
