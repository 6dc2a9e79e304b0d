"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from gustwatch.catalogue.base import QUERIES, SQL

for _module in ("profile", "features", "events", "decisions", "evaluation", "sequences", "models", "model_checks", "pipelines"):
    import_module(f"gustwatch.catalogue.{_module}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
