"""All registered queries and oracles."""

from __future__ import annotations

from merchgrid.plans import catalog, content, core, files, matching, reports, review

MODULES = [core, catalog, matching, content, review, reports, files]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
