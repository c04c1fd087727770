"""Whole queries of several operators."""

from . import star  # noqa: F401
