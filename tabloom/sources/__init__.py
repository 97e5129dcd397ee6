"""Readers and writers."""

from .records import read_source, sheet_names

__all__ = ["read_source", "sheet_names"]
