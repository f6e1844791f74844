"""Imports every query module so that the registry is complete."""

from haplolake.plans import alignment_queries, cohort_queries, format_queries, interval_queries, sample_queries, sequence_queries, variant_queries  # noqa: F401
from haplolake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
