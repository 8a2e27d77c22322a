"""All queries of the core, and their SQL."""

from __future__ import annotations

from courtspark.plans import evaluation, general, relational, replay, scalars, state, writes

MODULES = [general, replay, relational, scalars, writes, state, evaluation]


def queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
