"""Adapters from the driver tables and the named queries on them."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, oracles) by name."""
    from kubestrata.plans import branch_queries, capture_queries, object_queries, shape_queries, state_queries, view_queries  # noqa: F401
    from kubestrata.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
