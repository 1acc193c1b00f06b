"""All registered queries."""

from __future__ import annotations

from . import queries_activity, queries_pages, queries_records  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
