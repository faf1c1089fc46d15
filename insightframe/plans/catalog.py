"""Imports every query module so the registry is complete, and exposes it."""
from __future__ import annotations

from . import (queries_extra, queries_model_prep, queries_models, queries_outcome,  # noqa: F401
               queries_profile, queries_report, queries_series)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
