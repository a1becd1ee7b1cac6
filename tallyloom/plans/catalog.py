"""All registered queries."""

from __future__ import annotations

from tallyloom.plans import (queries_files, queries_ingest, queries_merge, queries_metrics, queries_rhythm,  # noqa: F401 (register)
                             queries_sources)
from tallyloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
