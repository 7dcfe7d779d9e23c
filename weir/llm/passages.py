"""Repeated passages by sparse suffix arrays.

A text is the sequence of its words. A passage is repeated if ``length`` words in
a row also start earlier in the corpus (documents by id, nulls last, ties by text
hash; within a document by position). The result is the exact union of all
repeated windows of ``length`` words, as maximal spans per document.

Only suffixes at minimisers are kept: of every ``length - gram + 1`` grams in a row
the one with the smallest hash (the first one if hashes tie). Content alone
selects them, so equal windows hold the same minimiser at the same place. Suffixes
whose first gram occurs once leave. The others are extended left and right to
every window of ``length`` words that they are the minimiser of, windows are brought
together by their content (96 bits of hash), and in each group the earliest
stays. Windows, not pairs, are shuffled, so a passage in a third of all documents
costs a row per window and no more.

Texts that are equal word for word meet before all that: the first one takes
part, the others are copies from their first to their last word, if they have
``length`` words or more. Null, empty and shorter texts have no windows. Rows that
repeat an id and a text are one document. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import dense_index
from .common import WORD, stored

LENGTH = 50
GRAM = 25
SEED = 11
_WORD = re.compile(WORD)
DOC = ["no_id", "id", "th"]
# A place is doc << WORD_BITS | word: up to 2^26 words in a text, 2^37 documents.
WORD_BITS = 26


class Hashes:
    """Hashes of every stretch of a byte string from running sums: sum of t[byte] * base^i, shifted back to 0."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, "u8")
        self.base = int(rng.integers(0, 2**62)) * 8 + 5
        self.power = self.inverse = np.ones(1, "u8")

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.multiply.accumulate(np.r_[np.ones(1, "u8"), np.full(size - 1, x, "u8")]) for x in (self.base, pow(self.base, -1, 2**64)))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        self._reach(len(raw) + 1)
        out = np.zeros(len(raw) + 1, "u8")
        np.cumsum(self.table[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


_FIRST, _SECOND = Hashes(SEED), Hashes(SEED + 1)


def _words(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by blanks, as bytes and array, with the byte each word starts and ends at."""
    joined = b" ".join((text or "").encode("utf-8", "replace").split())
    raw = np.frombuffer(joined, np.uint8)
    if not joined:
        return joined, raw, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(np.flatnonzero(raw == 32), len(raw))
    return joined, raw, np.append(0, ends[:-1] + 1), ends


def _selected(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes by word, and for every window the word its minimiser starts at."""
    sums = _FIRST.sums(raw)
    grams = _FIRST.of(sums, starts[: len(starts) - gram + 1], ends[gram - 1 :])
    width = length - gram + 1
    at = np.empty(len(grams) - width + 1, np.int64)
    for s in range(0, len(at), 65536):
        block = np.lib.stride_tricks.sliding_window_view(grams[s : s + 65536 + width - 1], width)
        at[s : s + 65536] = block.argmin(1) + np.arange(s, s + len(block))
    return sums, grams, at


def minimisers(text: str | None, length: int = LENGTH, gram: int = GRAM) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """Number of words, digest of the words, positions of the minimisers and hashes of their grams."""
    import xxhash

    joined, raw, starts, ends = _words(text)
    digest = xxhash.xxh3_128_digest(joined, SEED)
    if len(starts) < length:
        return len(starts), digest, np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, grams, at = _selected(raw, starts, ends, length, gram)
    places = at[np.r_[True, at[1:] != at[:-1]]]  # a minimiser's windows are neighbours
    return len(starts), digest, places, grams[places].view("i8")


def windows(text: str, wanted: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and two hashes of the windows whose minimiser lies at one of the wanted positions."""
    _, raw, starts, ends = _words(text)
    sums, _, at = _selected(raw, starts, ends, length, gram)
    use = np.flatnonzero(np.isin(at, wanted))
    a = _FIRST.of(sums, starts[use], ends[use + length - 1])
    b = _SECOND.of(_SECOND.sums(raw), starts[use], ends[use + length - 1])
    return use, a.view("i8"), (b >> np.uint64(32)).astype("u4").view("i4")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(t).alias("th"), F.col(text).alias("text"))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("spot", T.LongType())]))


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, start, end, first_doc_id): maximal repeated spans in words, end exclusive.

    ``first_doc_id`` is the document in which the span's first window occurs first.
    """
    rows = _keyed(docs, id_col, text)

    @F.pandas_udf(T.StructType([T.StructField("words", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("gram", T.ArrayType(T.LongType()))]))
    def sketch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([minimisers(t, length, gram) for t in texts], columns=["words", "key", "at", "gram"])

    sketched = stored(rows.select(*DOC, sketch("text").alias("s")).select(*DOC, "s.*").where(F.col("words") >= length))
    # Documents by number, in corpus order; a place is a number and a word in one long.
    docs_of = stored(dense_index(sketched.select(*DOC, "words", "key").distinct(), DOC, "doc"))
    firsts = docs_of.groupBy("key").agg(F.min("doc").alias("first"))
    judged = stored(docs_of.join(firsts, "key").drop("key"))
    # Later copies of a whole text, and the documents that take part.
    copies = judged.where("doc > first").select("doc", F.lit(0).cast("long").alias("start"), F.col("words").alias("end"), "first")
    part = judged.where("doc = first").select(*DOC, "doc")
    # A text that occurs as a copy too counts once: its grams are those of one document.
    own = sketched.join(part, DOC).dropDuplicates(["doc"]).select("doc", F.explode(F.arrays_zip("at", "gram")).alias("m")).select("doc", "m.at", "m.gram")
    often = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    wanted = own.join(often, "gram", "left_semi").groupBy("doc").agg(F.collect_list("at").alias("wanted")).join(part, "doc")

    def extend(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc, t, at in zip(part["doc"], part["text"], part["wanted"]):
                start, a, b = windows(t, np.asarray(at), length, gram)
                for s in range(0, len(start), 65536):
                    yield pd.DataFrame({"place": (int(doc) << WORD_BITS) + start[s : s + 65536], "a": a[s : s + 65536], "b": b[s : s + 65536]})

    texts = rows.join(wanted, DOC).dropDuplicates(["doc"])
    found = stored(texts.select("doc", "text", "wanted").mapInPandas(extend, "place long, a long, b int"))
    first = found.groupBy("a", "b").agg(F.min("place").alias("spot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b", "spot")
    later = found.join(first, ["a", "b"]).where("place > spot")

    @F.pandas_udf(SPAN)
    def merged(starts: pd.Series, spots: pd.Series) -> pd.Series:
        out = []
        for own, spot in zip(starts, spots):
            x, spot = np.asarray(own, np.int64), np.asarray(spot, np.int64)
            order = np.argsort(x)
            x, spot = x[order], spot[order]
            cut = np.flatnonzero(np.diff(x) > length) + 1
            # Windows that overlap or touch form one span, which goes by its first window.
            head, tail = np.r_[0, cut], np.r_[cut, len(x)] - 1
            out.append([{"start": int(x[h]), "end": int(x[e]) + length, "spot": int(spot[h])} for h, e in zip(head, tail)])
        return pd.Series(out, dtype=object)

    low = (1 << WORD_BITS) - 1
    by_doc = later.groupBy(F.shiftright("place", WORD_BITS).alias("doc")).agg(F.collect_list(F.struct(F.col("place").bitwiseAND(low).alias("s"), "spot")).alias("w"))
    spans = by_doc.select("doc", F.explode(merged(F.transform("w", lambda w: w["s"]), F.transform("w", lambda w: w["spot"]))).alias("s"))
    spans = spans.select("doc", "s.start", "s.end", F.shiftright("s.spot", WORD_BITS).alias("first"))
    ids = F.when(~F.col("no_id"), F.col("id"))
    names = judged.select("doc", ids.alias("doc_id"), F.col("th").alias("text_key"))
    origin = judged.select(F.col("doc").alias("first"), ids.alias("first_doc_id"))
    return spans.unionByName(copies).join(names, "doc").join(origin, "first").select("doc_id", "text_key", "start", "end", "first_doc_id")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (sorted, disjoint) and the white space before them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : places[s - 1][1] if s else 0])
        at = places[e - 1][1]
    return "".join([*out, text[at:]])
