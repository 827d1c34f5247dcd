"""Queries over the given tables, one or more for every operator."""

from __future__ import annotations


def load():
    """(queries, SQL) of all modules."""
    from mailsieve.checks import of_gaps, of_ingest, of_mail, of_policy, of_tables, of_tenants, of_text, of_time  # noqa: F401
    from mailsieve.checks.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
