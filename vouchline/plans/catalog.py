"""All registered queries."""

from vouchline.plans.registry import QUERIES, SQL

from vouchline.plans import enrichment, quality, review, shaping  # noqa: F401

__all__ = ["QUERIES", "SQL"]
