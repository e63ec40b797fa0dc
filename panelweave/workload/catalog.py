"""Every registered query."""

from __future__ import annotations

import importlib

from panelweave.workload.standins import Query

AREAS = ["quality", "markers", "metrics", "naming", "sampling", "setops", "panels", "graph", "factors", "ranks_from_data", "selection", "selections", "summaries", "files"]


def all_queries() -> list[Query]:
    out: list[Query] = []
    for area in AREAS:
        out.extend(importlib.import_module(f"panelweave.workload.{area}").QUERIES)
    names = [q.name for q in out]
    if len(names) != len(set(names)):
        raise ValueError("duplicate query names")
    return out
