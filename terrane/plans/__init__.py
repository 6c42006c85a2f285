"""Queries over the provided tables, by subject."""

from __future__ import annotations

import importlib

from terrane.plans.registry import QUERIES, SQL, Tables

_SUBJECTS = ("signature", "relational", "temporal", "curves", "spatial", "scan", "statements", "entry", "population", "areas", "stored")

for _subject in _SUBJECTS:
    importlib.import_module(f"terrane.plans.{_subject}")

__all__ = ["QUERIES", "SQL", "Tables"]
