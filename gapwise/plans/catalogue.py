"""Importing this module registers every query."""

from gapwise.plans import (  # noqa: F401
    learn_queries,
    model_queries,
    prepare_queries,
    source_queries,
)
from gapwise.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
