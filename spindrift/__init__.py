"""Span analytics on Spark: find, verify, score, redact and export personal data in large text collections."""

from .plans.options import Options
from .plans.pipeline import analyze, analyze_distinct, batch_summary, redact

__all__ = ["Options", "analyze", "analyze_distinct", "batch_summary", "redact"]
