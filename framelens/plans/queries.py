"""Imports every module that registers queries."""

from framelens.plans import error_queries, model_queries, source_queries, trace_queries  # noqa: F401


def load() -> None:
    """Registration happens on import; calling this keeps the import from looking unused."""
