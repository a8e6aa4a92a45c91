"""All registered queries, by operator id."""

from __future__ import annotations

from importlib import import_module

from tonemark.queries.base import Check

_PARTS = [
    "text", "quality", "accuracy", "latency", "sets", "segments", "gates", "records", "files", "verification",
    "service",
]


def all_checks() -> dict[str, Check]:
    checks: dict[str, Check] = {}
    for part in _PARTS:
        checks.update(import_module(f"tonemark.queries.{part}").QUERIES)
    return checks
