"""Scalar functions by family."""

from . import markup, masking, scalars  # noqa: F401
