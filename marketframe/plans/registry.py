"""Imports every query module so that all queries are registered."""

from __future__ import annotations

from . import q_features, q_learn, q_models, q_quality_io, q_serving  # noqa: F401
from .catalog import REGISTRY


def queries():
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_sql():
    return {k: q.sql for k, q in REGISTRY.items() if q.sql is not None}
