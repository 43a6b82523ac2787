"""Subpackage of impactframe."""
