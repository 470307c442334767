"""Registered queries, grouped by area."""
from __future__ import annotations

from importlib import import_module

AREAS = ("text", "scores", "planning", "symbols", "signals", "listening", "logs", "training", "criteria", "streams", "files")


def load_all() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
