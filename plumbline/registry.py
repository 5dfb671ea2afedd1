"""All registered queries and the SQL that checks them, gathered from the query modules."""

from __future__ import annotations

from plumbline.plans import base, drawing, exchange, filters, governance, graphs, joins, ordered, product, scalars, sheets, takeoff  # noqa: F401

FLAGSHIP = "quantity_by_designation"


def queries() -> dict:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
