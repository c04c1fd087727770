"""Sources and sinks."""

from . import custom, formats, log  # noqa: F401
