"""Registered queries over the driver tables, each beside the SQL that must give the same rows."""

from driver_queries.registry import ORACLES, QUERIES
from driver_queries import (  # noqa: F401  (importing registers the queries)
    alignment,
    cohort,
    documents,
    exports,
    mention_forms,
    mentions,
    noise,
    quality,
    records,
    scans,
    splits,
    steps,
    windows,
)

__all__ = ["ORACLES", "QUERIES"]
