"""Relational operators: filters, joins, aggregates, windows, sorts, set operations, user-defined functions."""

from . import aggregates, filters, joins, nearest, overlap, scans, sets, sketches, udfs, windows  # noqa: F401
