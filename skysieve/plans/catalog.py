"""Collects the query modules."""

from __future__ import annotations

from skysieve.plans import (  # noqa: F401
    catalogue_queries,
    decision_queries,
    evaluation_queries,
    frame_queries,
    learning_queries,
    linking_queries,
    review_queries,
)
from skysieve.plans.registry import QUERIES, TWINS


def queries():
    return dict(QUERIES)


def twins():
    return dict(TWINS)
