"""Registered queries over the given tables, with the same results as plain SQL."""

from . import classes, features, files, filters, joins, prepared, profiles, rasters, sqltext, unions
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

_MODULES = (
    classes, features, files, filters, joins, prepared, profiles, rasters, sqltext, unions,
)
