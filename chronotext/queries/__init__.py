"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from chronotext.queries import alignment, files, library, names, pages, recognition, records, search, signals, speech, sponsors, streams, text, vectors  # noqa: F401
from chronotext.queries.registry import ORACLES, QUERIES, Query


def reference_queries() -> dict[str, Query]:
    return dict(QUERIES)


def reference_oracles() -> dict[str, str]:
    return dict(ORACLES)
