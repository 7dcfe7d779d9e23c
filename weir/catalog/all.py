"""Imports every query module, which fills the registry."""

from . import text_queries, pattern_queries, telemetry_queries, capacity_queries  # noqa: F401, I001
from . import stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
