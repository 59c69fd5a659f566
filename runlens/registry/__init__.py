"""Registered queries over the given tables."""

from . import files, ordered, results, streams  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
