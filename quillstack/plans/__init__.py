"""Registered queries over the reference operators, with the SQL they are compared with."""

from __future__ import annotations

from . import attributes, documents, markup, texts  # noqa: F401


def queries() -> dict:
    return dict(texts.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(texts.SQL)
