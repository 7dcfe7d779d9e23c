"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default whitespace delimiters of a string tokenizer.
WHITESPACE = r"[ \t\n\r\f]+"
# Fixed value: Unicode punctuation and symbols.
PUNCT_SYMBOL = r"\p{P}|\p{S}"


def words(text: Column | str, pattern: str = WHITESPACE) -> Column:
    """Array of the non-empty tokens of ``text``."""
    return F.filter(F.split(text, pattern), lambda x: x != "")


def charset_pattern(delims: str) -> str:
    """Character class in which every character of ``delims`` is a delimiter."""
    return "[" + "".join("\\" + c if not c.isalnum() else c for c in delims) + "]"


def strip_punctuation(text: Column | str) -> Column:
    return F.regexp_replace(text, PUNCT_SYMBOL, " ")


def suffixed(word: Column | str, suffix: str = "!!") -> Column:
    return F.concat(F.col(word) if isinstance(word, str) else word, F.lit(suffix))


def row_sid(prefix: str, task: Column, counter: Column) -> Column:
    """Row id ``prefix-task-counter``."""
    return F.concat_ws("-", F.lit(prefix), task.cast("string"), counter.cast("string"))


def trace_id(ident: Column, time: Column | None = None) -> Column:
    """Trace id ``id-time``, or the id alone when rows carry a counter only."""
    parts = [ident.cast("string")]
    if time is not None:
        parts.append(time.cast("string"))
    return F.concat_ws("-", *parts)
