"""Word counts over a text stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import text as X
from .runs import drain_to_parquet, drain_updates


def queue_rows(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All rows of a file queue, read once each."""
    return drain_to_parquet(stream, "queue", folder)


def word_count(stream: DataFrame, text: str, folder: str | None = None) -> DataFrame:
    """Running counts kept in the state store; returns the last count per word."""
    return drain_updates(X.word_count(X.tokenize(stream, text)), ["word"], "word-count", folder)
