"""Quality rules by distribution divergence, with DataFrame functions only.

Two histograms of a text are compared with the reference of its language: shares of
character classes, and shares of the language's ``COMMON`` most common words with
one more bin for all other words. The measure is the Jensen-Shannon distance, the
root of the divergence to base 2, between 0 and 1. A text fails if a distance is
above its limit. A short text strays from its reference by chance: the divergence of
a histogram of B bins from n draws has a mean of about (B - 1) / (8 n ln 2), so
``SLACK`` times that is taken off before the root.

References come from the corpus itself, from all texts of ``MIN_WORDS`` words or
more. Every text weighs the same there, whatever its length, in whole numbers, so
sums do not depend on the order of rows. A reference of fewer than ``MIN_TEXTS``
texts judges nobody: the texts of so rare a language are kept. So are, as to
characters, texts of fewer than ``MIN_CHARS`` characters. Rows without a language
form a language of their own.

The base rules come first: a text fails with fewer than ``MIN_WORDS`` words, or if
more than half of its words lie in three-word windows that the text holds twice or
more. Windows are compared by 64-bit hash.

Null texts count as empty; they fail the base rules. A row is judged by itself, so
repeated rows and ties get equal results, and an empty table gives an empty one.
Extra columns stay, except those that have the name of a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import broadcast_if_small
from ..session import materialize

MIN_WORDS = 50
MIN_CHARS = 200
MIN_TEXTS = 20
COMMON = 32
MAX_CHARS = 0.3
MAX_WORDS = 0.2
SLACK = 3.0
UNIT = 1_000_000_000

# White space, symbols, and the character classes, taken off a text one after the other.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
CLASSES = ["[a-z]+", "[A-Z]+", SPACES, "[.,;:?!'\"()\\-]+", "[0-9]+", "[\\x00-\\x7F]+"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more, the first ones included."""

    def covered(at: Column) -> Column:
        # Starts of repeated windows in order: each adds the words up to the next start, three at most.
        gaps = F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def of_sorted(s: Column) -> Column:
        twin = lambda e, k: F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"])), covered)

    def of_hashes(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, of_sorted))

    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return let(F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), of_hashes)


def class_counts(text: Column, symbols: bool = False) -> Column:
    """Characters of each class, the last one all that is left; with ``symbols`` the symbols come after that.

    Symbols are neither letters nor spaces, so they are counted in the little that those leave.
    """

    def strip(left: Column, rest: list[str], found: list[Column], marks: list[Column]) -> Column:
        if symbols and not marks and len(found) == CLASSES.index(SPACES) + 1:
            marks = [F.length(left) - F.length(F.regexp_replace(left, SYMBOLS, ""))]
        if not rest:
            return F.array(*found, F.length(left), *marks)
        return let(F.regexp_replace(left, rest[0], ""), lambda shorter: strip(shorter, rest[1:], [*found, F.length(left) - F.length(shorter)], marks))

    return strip(text, CLASSES, [], [])


def distance(divergence: Column, bins: int, draws: Column, slack: float = SLACK) -> Column:
    """Root of a divergence less what chance adds to it."""
    chance = slack * (bins - 1) / (8 * math.log(2))
    return F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), divergence - chance / F.greatest(draws, F.lit(1)))))


def part(p: Column, q: Column) -> Column:
    """What one bin adds to the divergence: p log2(p / m) + q log2(q / m), halved, m the mean."""
    m = (p + q) / 2
    side = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (side(p) + side(q)) / 2


def class_divergence(counts: Column, shares: Column) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda s, c: s + c)
    return let(total, lambda n: F.aggregate(F.zip_with(counts, shares, lambda c, q: part(c / F.greatest(n, F.lit(1)), q)), F.lit(0.0), lambda s, x: s + x))


def word_divergence(words: Column, common: Column, longest: Column, shares: Column) -> Column:
    """``shares[0]`` is the share of all other words, ``shares[k]`` that of the kth common word.

    Words of more characters than the ``longest`` common one are not looked up: lower case never shortens a word.
    """
    n = F.greatest(F.size(words), F.lit(1))

    def of_sorted(s: Column) -> Column:
        # The last place of each bin that occurs; absent bins add half of their share.
        ends = F.filter(F.transform(s, lambda b, k: F.when(F.coalesce(F.get(s, k + 1) == b, F.lit(False)), -1).otherwise(k)), lambda e: e >= 0)
        return let(ends, lambda e: summed(s, e))

    def summed(s: Column, ends: Column) -> Column:
        def one(e: Column, k: Column) -> Column:
            p = (e - F.coalesce(F.get(ends, k - 1), F.lit(-1))) / n
            q = F.get(shares, F.get(s, e).cast("int"))
            return F.struct(part(p, q).alias("d"), q.alias("q"))

        zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"))
        both = F.aggregate(F.transform(ends, one), zero, lambda a, x: F.struct((a["d"] + x["d"]).alias("d"), (a["q"] + x["q"]).alias("q")))
        return let(both, lambda b: b["d"] + F.greatest(F.lit(0.0), 1 - b["q"]) / 2)

    bin_of = lambda w: F.when(F.length(w) > longest, F.lit(0).cast("long")).otherwise(F.array_position(common, F.lower(w)))
    return let(F.sort_array(F.transform(words, bin_of)), of_sorted)


def references(docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(ref_lang, class_shares, common, longest, word_shares), a row per language with ``min_texts`` texts or more.

    One pass over the texts and one shuffle of partial sums by (language, word).
    """
    share = lambda count, whole: F.floor(count * F.lit(float(UNIT)) / whole)
    # Besides its words a text sends one mark a class and two for totals; no word begins with a blank.
    marks = F.array(*[F.lit(f" {i}") for i in range(len(CLASSES) + 3)])
    t = F.coalesce(F.col(text), F.lit(""))

    def sent(w: Column) -> Column:
        of_marks = let(class_counts(t), lambda c: F.transform(c, lambda x: share(x, F.length(t))))
        totals = F.array(F.lit(1).cast("long"), F.size(w) * share(F.lit(1), F.size(w)))
        return F.when(F.size(w) >= MIN_WORDS, F.struct(share(F.lit(1), F.size(w)).alias("unit"), F.concat(of_marks, totals).alias("other"), F.concat(w, marks).alias("w")))

    # Outer, since the planner would compute the words once more to leave out empty lists.
    rows = docs.select(F.col(lang).alias("lang"), let(words_of(t), sent).alias("s"))
    each = rows.select("lang", F.col("s.unit").alias("unit"), F.col("s.other").alias("other"), F.explode_outer("s.w").alias("x")).where("x is not null")
    weight = F.when(F.col("x").startswith(" "), F.get("other", F.substring("x", 2, 2).cast("int"))).otherwise(F.col("unit"))
    by_key = each.groupBy("lang", F.lower("x").alias("x")).agg(F.sum(weight).alias("weight"))
    at = F.when(F.col("x").startswith(" "), F.substring("x", 2, 2).cast("int"))
    kind = F.when(at.isNull(), "word").when(at < len(CLASSES) + 1, "class").when(at == len(CLASSES) + 1, "texts").otherwise("words")
    sums = by_key.select("lang", kind.alias("kind"), F.ltrim("x").alias("key"), "weight")
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("weight"), "key")
    ranked = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= common)
    # At most ``common`` rows of each kind are left per language.
    pick = lambda kind, *cols: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*cols))))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("weight")))
    by = ranked.groupBy("lang").agg(
        pick("word", "rank", "key", "weight").alias("top"), pick("class", F.col("key").cast("int").alias("at"), "weight").alias("classes"),
        one("texts").alias("texts"), one("words").alias("words"),
    ).where(F.col("texts") >= min_texts)
    of_class = F.transform("classes", lambda c: c["weight"] / F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x["weight"]))
    top = F.transform("top", lambda w: w["weight"] / F.col("words"))
    other = F.greatest(F.lit(0.0), 1 - F.aggregate(top, F.lit(0.0), lambda s, x: s + x))
    common_words = F.transform("top", lambda w: w["key"])
    longest = F.array_max(F.transform(common_words, lambda w: F.length(w)))
    return by.select(F.col("lang").alias("ref_lang"), of_class.alias("class_shares"), common_words.alias("common"), longest.alias("longest"), F.concat(F.array(other), top).alias("word_shares"))


def measured(text: Column) -> Column:
    """Struct of all measures of one text beside the columns of its language's reference."""
    judges = F.col("class_shares").isNotNull()

    def of(w: Column) -> Column:
        return let(class_counts(text, symbols=True), lambda c: together(w, F.slice(c, 1, len(CLASSES) + 1), c[len(CLASSES) + 1]))

    def together(w: Column, classes: Column, symbols: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))
        n, chars = F.size(w), F.length(text)
        char_distance = F.when(judges & (n >= MIN_WORDS) & (chars >= MIN_CHARS), distance(class_divergence(classes, F.col("class_shares")), len(CLASSES) + 1, chars))
        word_distance = F.when(judges & (n >= MIN_WORDS), distance(word_divergence(w, F.col("common"), F.col("longest"), F.col("word_shares")), COMMON + 1, n))
        return F.struct(
            n.cast("long").alias("n_words"), (chars - classes[CLASSES.index(SPACES)]).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"), char_distance.alias("char_distance"), word_distance.alias("word_distance"),
        )

    return let(words_of(text), of)


def judge(
    docs: DataFrame, text: str = "text", lang: str = "lang", refs: DataFrame | None = None,
    max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS,
) -> DataFrame:
    """Adds the base measures, ``base_failed``, ``char_distance``, ``word_distance`` (null where nobody judges) and ``kept``."""
    refs = materialize(references(docs, text, lang)) if refs is None else refs
    results = {*MEASURES, "base_failed", "char_distance", "word_distance", "kept"}
    own = [c for c in docs.columns if c.lower() not in results]
    # Names of our own under a prefix, so that no column of the table clashes with them.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(f"`{lang}`").alias("__lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    joined = rows.join(broadcast_if_small(refs), F.col("__lang").eqNullSafe(F.col("ref_lang")), "left").select("__row", measured(F.col("__text")).alias("__m"))
    m = F.col("__m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    within = F.coalesce(m["char_distance"] <= max_chars, F.lit(True)) & F.coalesce(m["word_distance"] <= max_words, F.lit(True))
    found = [m[x].alias(x) for x in [*MEASURES, "char_distance", "word_distance"]]
    return joined.select("__row.*", *found, failed.alias("base_failed"), (~failed & within).alias("kept"))
