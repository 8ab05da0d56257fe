"""Registered queries; importing the package registers all of them."""

from foliant.plans import (  # noqa: F401
    chain,
    chunk,
    classify,
    clean,
    directory,
    extract,
    graphs,
    ordered,
    reports,
    retrieval,
    streams,
    sync,
)
from foliant.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
