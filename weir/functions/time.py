"""Epoch-millisecond helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts_ntz: str) -> Column:
    """Milliseconds since 1970-01-01 of a ``timestamp_ntz`` column."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts_ntz})")


def bucket_start(time_ms: Column | str, width_ms: int) -> Column:
    """Start of the tumbling window that holds ``time_ms``."""
    c = F.col(time_ms) if isinstance(time_ms, str) else time_ms
    return c - F.pmod(c, F.lit(width_ms))
