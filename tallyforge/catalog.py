"""All registered queries of the invoice engine and their SQL."""

from __future__ import annotations

from tallyforge.plans import details, feeds, ledger, lookups, matching, parsing, prices, recognised, records, registry, reports, saves, suppliers, templates, texts, upkeep  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
