"""Canonical inputs, registered queries and their check SQL."""

from .registry import ORACLES, QUERIES  # noqa: F401
