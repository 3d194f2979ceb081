"""Registered queries; importing this package registers them."""

from . import documents, relations, scalars, verbs  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
