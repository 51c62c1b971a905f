"""Operators over the archive's tables."""
