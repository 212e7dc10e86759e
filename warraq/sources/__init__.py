"""Readers and writers."""

from warraq.sources.tables import load

__all__ = ["load"]
