"""Structured Streaming over the event table."""

from . import events  # noqa: F401
