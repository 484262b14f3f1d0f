"""Queries over the supplied tables, one or more per operator, with their SQL."""
from __future__ import annotations

import importlib

from . import base

MODULES = ["scans", "encodings", "composites", "blocks", "accuracy", "spatial", "focal", "planning", "radar", "raw_scenes", "overlays",
           "incremental", "scoring", "streams"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(base.ORACLE)


def covers() -> dict:
    _load()
    return dict(base.COVERS)
