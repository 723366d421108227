"""Registered queries."""

from . import carving, files, models, points, reports, sequences, shapes, stores  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
