"""Effort analytics for work requirements, expressed as Spark plans."""

__version__ = "0.1.0"
