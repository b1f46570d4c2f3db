"""Whole-report plans."""

from .report import full_report, ml_capabilities

__all__ = ["full_report", "ml_capabilities"]
