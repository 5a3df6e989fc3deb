"""Registered queries over the given tables, each with its oracle SQL where SQL can say it."""

from siterank.catalog import areas, attributes, consolidation, files, intake, ranking, records, runs, spatial, texts  # noqa: F401
from siterank.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
