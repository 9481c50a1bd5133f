"""Registered queries over the given tables."""

from kudoscope.catalog import cleaning, exploration, features, functions, models, relational, sources  # noqa: F401
from kudoscope.catalog.registry import ORACLES, QUERIES

FLAGSHIP = "D2_city_mean_median"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
