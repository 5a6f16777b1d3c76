"""Imports every query module so that the registry is complete."""

from daygrid.plans import (  # noqa: F401
    dialogue_queries,
    evaluation_queries,
    profile_queries,
    quality_queries,
    recode_queries,
    series_queries,
    source_queries,
    split_queries,
    stats_queries,
    training_queries,
)
from daygrid.plans.registry import REGISTRY, run_query

__all__ = ["REGISTRY", "run_query"]
