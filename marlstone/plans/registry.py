"""Registered queries over the driver's tables and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .base import ORACLE, QUERIES
from . import boards, metrics, scalars, tables, waveforms  # noqa: F401  each registers its queries

__all__ = ["ORACLE", "QUERIES"]
