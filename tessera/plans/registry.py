"""The registered queries outside the llm subpackage, with the SQL that checks them."""

from __future__ import annotations

from tessera.plans import lookup_queries, report_queries, store_queries  # noqa: F401  add their queries
from tessera.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
