"""Registered queries, each with an independent DuckDB statement where SQL can express it."""

from finweave.plans import fundamentals, market, models, risk, texts
from finweave.plans.registry import ORACLES, QUERIES

__all__ = ["fundamentals", "market", "models", "oracles", "queries", "risk", "texts"]


def queries() -> dict:
    return QUERIES


def oracles() -> dict:
    return ORACLES
