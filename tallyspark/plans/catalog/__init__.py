"""Registered queries: each operator over the given tables, with the same
question in plain SQL where SQL can ask it."""

from __future__ import annotations

from tallyspark.plans.catalog import (changes, documents, forecasts, goals, governance, overviews, quality, security,
                                      slicing, streams)
from tallyspark.plans.catalog.registry import ORACLES, QUERIES

MODULES = (slicing, overviews, changes, goals, security, quality, forecasts, documents, governance, streams)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
