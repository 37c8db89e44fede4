"""Registered queries over the given tables."""

from . import alignment, cleaning, expressions, flagship, modelling, publishing, sampling, scoring  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
