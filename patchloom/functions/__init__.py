"""Subpackage: functions."""
