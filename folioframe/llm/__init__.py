"""Operators of training-data pipelines. Nothing else in the package imports this."""

from __future__ import annotations


def queries() -> dict:
    from . import catalogue

    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue

    return dict(catalogue.ORACLE_SQL)
