"""Subpackage: operators."""
