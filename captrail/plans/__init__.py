"""Registered queries, one module per theme."""

from __future__ import annotations

import importlib

MODULES = ("timeline", "scalars", "video", "tracks", "changes", "speech", "evaluation", "records", "operations")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"captrail.plans.{name}")
