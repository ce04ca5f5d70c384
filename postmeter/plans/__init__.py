"""Registered queries: a role binding, an operator, and the SQL that states the same result."""

from __future__ import annotations

import importlib

MODULES = ("trends", "items", "comparison", "forecasting", "similarities", "texts", "postings", "ledger")


def all_queries():
    """(queries, SQL) of every module."""
    from postmeter.plans import registry

    for m in MODULES:
        importlib.import_module(f"postmeter.plans.{m}")
    return registry.QUERIES, registry.ORACLE_SQL
