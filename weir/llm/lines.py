"""Line dedup: repeated runs of lines found by distributed prefix doubling.

Every document is the sequence of its lines that are not blank; the corpus is the
sequence of all documents by id (nulls last, ties by text hash). A line is deleted
if it lies in a run of lines of its document that also starts earlier in the
corpus and has ``min_chars`` characters or more without outer white space. Blank
lines stay.

A start is followed by exactly one shortest window that reaches ``min_chars``,
and its length depends on its text alone; so does the shortest window before an
end. The windows of both kinds within a repeated run cover the run, so the run
is repeated if and only if its windows are. Windows get their names by prefix
doubling: ranks of single lines first, then ranks of 2, 4, 8 ... lines as ranks
of pairs, sorted like the suffixes they begin; a window of any length is named by
the two overlapping powers of two that cover it. Windows with equal names are one
interval of the suffix array whose common prefix is at least the window; its
earliest member stays, the others are later copies. Lines that occur once leave
before the first round, and only documents with windows of several lines take
part in the doubling, whose rounds end at log2(min_chars).

A null text has no lines and stays null, the empty text stays empty. Rows that
repeat an id and a text are one document and get equal results. Extra columns
pass through. A text with nothing to delete is returned as it was.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import dense_index
from ..session import materialize
from .common import join_counted, with_columns

MIN_CHARS = 20
DOC = ["no_id", "id", "th"]
AT = [*DOC, "line"]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(no_id, id, th, line, at, chars, h, g): the lines that are not blank, numbered, with two hashes."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
        F.posexplode(F.split(text, "\n", -1)).alias("at", "content"),
    )
    kept = rows.withColumn("chars", F.length(F.trim("content"))).where("chars > 0")
    return kept.select(*DOC, "at", "chars", F.xxhash64("content").alias("h"), F.hash("content").alias("g"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """The lines whose content occurs more than once, with a dense rank of the content."""
    often = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    ranks = dense_index(often, ["h", "g"], "rank")
    return lines.join(ranks, ["h", "g"])


def windows(rows: DataFrame, min_chars: int) -> DataFrame:
    """Shortest windows that reach ``min_chars``: (doc, line, size), from each start and to each end.

    ``line`` numbers the lines of a document that are not blank. A gap in ``line``
    is a line that occurs once; no repeated run crosses it.
    """
    run = Window.partitionBy(*DOC, "run").orderBy("line")
    back = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy(*DOC).orderBy("line")))
    # Ends of windows by a search in running sums: each line has at least one character.
    sums = rows.withColumn("sum", F.sum("chars").over(back))
    near = run.rowsBetween(0, min_chars - 1)
    past = run.rowsBetween(-(min_chars - 1), 0)
    ahead = sums.select(
        *AT, "sum", "chars", "rank",
        F.collect_list(F.struct("line", "sum")).over(near).alias("ahead"), F.collect_list(F.struct("line", F.expr("sum - chars").alias("before"))).over(past).alias("behind"),
    )
    begin = F.col("sum") - F.col("chars")
    stop = F.get(F.filter("ahead", lambda x: x["sum"] - begin >= min_chars), F.lit(0))["line"]
    hits = F.filter("behind", lambda x: F.col("sum") - x["before"] >= min_chars)
    start = F.get(hits, F.size(hits) - 1)["line"]
    both = F.array(F.struct(F.col("line").alias("first"), stop.alias("last")), F.struct(start.alias("first"), F.col("line").alias("last")))
    found = ahead.select(*DOC, F.explode(both).alias("w")).where("w.first is not null and w.last is not null")
    return found.select(*DOC, F.col("w.first").alias("line"), (F.col("w.last") - F.col("w.first") + 1).cast("int").alias("size")).distinct()


def doubled(level: DataFrame, step: int) -> DataFrame:
    """Ranks of 2 x step lines from ranks of step lines; only prefixes that repeat go on."""
    later = level.select(*DOC, (F.col("line") - step).alias("line"), F.col("rank").alias("second"))
    pairs = level.join(later, AT)
    often = pairs.groupBy("rank", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank", "second")
    ranks = dense_index(often, ["rank", "second"], "next")
    return pairs.join(ranks, ["rank", "second"]).select(*AT, F.col("next").alias("rank"))


def deleted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(no_id, id, th, at): the lines, numbered from 0 with blank ones, that are later copies."""
    # Repeated rows are one document: their lines would be copies of themselves.
    lines = lines_of(docs, id_col, text).distinct()
    numbered = lines.withColumn("line", F.row_number().over(Window.partitionBy(*DOC).orderBy("at")).cast("long"))
    rows = materialize(repeated_lines(numbered).select(*AT, "at", "chars", "rank"))
    # A long line is a window of its own; the others are few and wait for the doubling.
    alone = rows.where(F.col("chars") >= min_chars).select(*AT, F.lit(1).alias("size"), F.col("rank").alias("a"), F.col("rank").alias("b"))
    short = rows.where(F.col("chars") < min_chars).select(*DOC).distinct()
    mixed = materialize(rows.join(short, DOC, "left_semi"))
    wanted = materialize(windows(mixed, min_chars).where("size > 1"))
    named = [alone]
    level, step = mixed.select(*AT, "rank"), 1
    longest = wanted.agg(F.max("size")).first()[0] or 0
    while 2 * step <= longest:
        level = materialize(doubled(level, step))
        step *= 2
        own = wanted.where((F.col("size") >= step) & (F.col("size") < 2 * step))
        tail = level.select(*DOC, F.col("line").alias("from"), F.col("rank").alias("b"))
        head = own.join(level.withColumnRenamed("rank", "a"), AT).withColumn("from", F.col("line") + F.col("size") - step)
        named.append(head.join(tail, [*DOC, "from"]).select(*AT, "size", "a", "b"))
    every = named[0]
    for more in named[1:]:
        every = every.union(more)
    every = materialize(every) if len(named) > 1 else every
    place = F.struct(*AT)
    first = every.groupBy("size", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_counted(every, materialize(first), ["size", "a", "b"]).where(place > F.col("first"))
    gone = later.select(*DOC, F.explode(F.sequence(F.col("line"), F.col("line") + F.col("size") - 1)).alias("line")).distinct()
    return gone.join(rows.select(*AT, "at"), AT).select(*DOC, "at")


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(t, lines):
        if t is None or lines is None:
            return None
        drop = set(lines)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)

    return pd.Series([cut(t, g) for t, g in zip(texts, gone)], dtype=object)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, gone: str | None = None) -> DataFrame:
    """Delete later copies of lines from the texts; ``gone`` names a column for the deleted line numbers."""
    dead = deleted(df, id_col, text, min_chars).groupBy(*DOC).agg(F.sort_array(F.collect_list("at")).alias("__gone"))
    keyed = with_columns(
        df, __no_id=F.col(id_col).isNull(), __id=F.coalesce(F.col(id_col).cast("long"), F.lit(0)), __th=F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    )
    dead = dead.select(F.col("no_id").alias("__no_id"), F.col("id").alias("__id"), F.col("th").alias("__th"), "__gone")
    joined = keyed.join(dead, ["__no_id", "__id", "__th"], "left")
    hit = F.col("__gone").isNotNull()
    # Only texts that lose a line go through Python.
    new = F.when(hit, _without(F.when(hit, F.col(text)), F.col("__gone"))).otherwise(F.col(text))
    out = [(new if c == text else F.col(f"`{c}`")).alias(c) for c in df.columns]
    return joined.select(*out, *([F.coalesce("__gone", F.array().cast("array<int>")).alias(gone)] if gone else []))
