"""Registered queries over the given tables, with SQL that checks them."""

from wardline.catalog import hospital, models, scoring, texts, timeline  # noqa: F401
from wardline.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
