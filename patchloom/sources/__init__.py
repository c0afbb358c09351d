"""Subpackage: sources."""
