"""All registered queries of the engine's own operators."""

from __future__ import annotations

from plumbline.plans import attribution, base, documents, geometry, ingest, jobs, pricing, revisions, rooms, routes, scans, texts  # noqa: F401  (registers)

FLAGSHIP = "estimate_totals"


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
