"""I-Match fingerprints, with DataFrame functions only.

The lexicon holds the terms whose inverse document frequency ln(N / df) lies in a
band; N and df count distinct texts, so copies weigh no more than one. A document's terms are its distinct lower-case
words that are in the lexicon. A seeded hash deals the lexicon into ``SLOTS``
random parts and cuts each part into nested random subsets, every one about half
of the one before. In each part a document uses the smallest subset that still
holds one of its terms: those terms are sorted and hashed. So short and long
texts alike are described by a few terms per slot, and an edit spoils the slots
whose few terms it touches, not all of them.

The likeness of two fingerprints is the share of equal slots among those that
either one fills. A text whose terms of the lexicon fill fewer than ``FEW`` slots has
the other slots filled by its terms outside the band: in each slot by the more
common terms nearest to the band, by terms too rare for it only in slots without
others. So edited copies stay alike if their group is so large that its terms leave the band. A
text without words has one hash of the whole text, which is like nothing but itself.

A term in the band has df >= N * exp(-high), and all df add up to N times the
mean number of distinct words, so the lexicon has at most mean * exp(high)
terms, whatever N is; the broadcast is measured all the same.

Null texts count as empty. A document is an id and a text: rows that repeat both
get equal results. Ids order documents, nulls come last, ties go by text hash.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Lag, broadcast_if_small, range_scan
from ..session import materialize

LOW, HIGH = 3.0, 7.0
SLOTS = 16
FEW = 8
SEED = 7
NONE = "."
# Tier of the terms too rare for the band: behind all common ones.
RARE = 1 << 30
KEY = ["kid", "kth"]


def terms(text: str | Column) -> Column:
    """Distinct lower-case words of a text; the empty string may be among them."""
    return F.array_distinct(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"))


def exploded(df: DataFrame, text: str | Column) -> DataFrame:
    """(kid, kth, term) with terms as 64-bit hashes."""
    words = df.select(*KEY, F.explode(terms(text)).alias("word")).where("word <> ''")
    return words.select(*KEY, F.xxhash64("word").alias("term"))


def weighed(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, tier): 0 for the terms with low <= ln(N / df) <= high, for more common ones how far they are from the band."""
    by_text = docs.withColumn("th", F.xxhash64(text))
    copies = by_text.groupBy("th").agg(F.count(F.lit(1)).alias("copies"))
    n = copies.count()
    again = broadcast_if_small(materialize(copies.where("copies > 1")))
    # Each copy of a text counts as its share of one.
    once = by_text.join(again, "th", "left").select(text, (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    words = once.select("share", F.explode(terms(text)).alias("word")).where("word <> ''").select(F.xxhash64("word").alias("term"), "share")
    df = words.groupBy("term").agg(F.round(F.sum("share"), 6).alias("df"))
    top = n * math.exp(-low)
    tier = F.when(F.col("df") <= top, 0).otherwise(F.ceil(F.log(F.col("df") / top))).cast("int")
    return df.where(F.col("df") >= n * math.exp(-high)).select("term", tier.alias("tier"))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """Hashes of the terms with low <= ln(N / df) <= high."""
    return weighed(docs, text, low, high).where("tier = 0").select("term")


def described_by(docs: DataFrame, text: str | Column, tiers: DataFrame) -> DataFrame:
    """(kid, kth, slots) of the texts: by terms of the lexicon, and by terms outside it where those fill few slots.

    Each text is exploded once and joined once, a row per term; a row per slot is left then.
    """
    return slots(exploded(docs, text).join(tiers, "term", "left").withColumn("tier", F.coalesce("tier", F.lit(RARE))))


def vocabulary(rows: DataFrame) -> DataFrame:
    """The tiers of the terms of the lexicon and of those too common for it."""
    return broadcast_if_small(materialize(weighed(rows)))


def slots(found: DataFrame, seed: int = SEED, count: int = SLOTS) -> DataFrame:
    """(kid, kth, slots): one hash per part of the lexicon from a document's terms (kid, kth, term, tier).

    In each slot the nearest tier counts, and of it the smallest nested subset that holds a
    term. If ``FEW`` slots or more have a term of tier 0, the others stay empty.
    """
    r = F.xxhash64("term", F.lit(seed))
    rest = F.shiftrightunsigned(r, 8).bitwiseOR(F.lit(1 << 55))
    # Trailing zeros: the number of nested subsets that a term lies in.
    depth = F.bit_count(rest.bitwiseAND(-rest) - 1)
    order = F.col("tier").cast("long") * 64 - depth
    dealt = found.select(*KEY, F.pmod(r, F.lit(count)).cast("int").alias("slot"), F.struct(order.alias("order"), F.col("term").alias("term")).alias("x"))
    sorted_terms = dealt.groupBy(*KEY, "slot").agg(F.sort_array(F.collect_list("x")).alias("x"))
    first = F.col("x")[0]["order"]
    chosen = F.transform(F.filter("x", lambda e: e["order"] == first), lambda e: e["term"])
    hashed = sorted_terms.select(*KEY, "slot", (first <= 0).alias("near"), F.hash(chosen, F.lit(seed)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"))
    each = [F.max(F.when(F.col("slot") == i, F.when(F.col("near"), F.col("hash")).otherwise(-1 - F.col("hash")))).alias(f"s{i}") for i in range(count)]
    by_text = hashed.groupBy(*KEY).agg(F.sum(F.col("near").cast("int")).alias("filled"), *each)
    # Terms outside the band are kept as negative numbers until it is known whether they are needed.
    pick = lambda c: F.when(F.col(c) >= 0, F.col(c)).when(F.col("filled") < FEW, -1 - F.col(c))
    return by_text.select(*KEY, F.array(*[pick(f"s{i}") for i in range(count)]).alias("slots"))


def printed(filled: Column, text: Column, count: int = SLOTS) -> Column:
    """The fingerprint as text: a hash or a point per slot, or the hash of a text without terms."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.coalesce(F.lower(F.hex(F.get(filled, i))), F.lit(NONE)))
    return F.when(filled.isNull(), F.concat(F.lit("text-"), F.sha2(text.cast("binary"), 256))).otherwise(F.array_join(parts, "-"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that either fingerprint fills."""
    either = F.size(F.filter(F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b")), lambda z: (z["a"] != NONE) | (z["b"] != NONE)))
    same = F.size(F.filter(F.arrays_zip(F.split(a, "-").alias("a"), F.split(b, "-").alias("b")), lambda z: (z["a"] == z["b"]) & (z["a"] != NONE)))
    plain = a.startswith("text-") | b.startswith("text-")
    return F.when(a == b, 1.0).when(plain, 0.0).otherwise(same / F.greatest(either, F.lit(1))).cast("double")


def keyed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text (never null), n_chars and the key of the document."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), t.alias("text"), F.length(t).cast("long").alias("n_chars"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("kid"), F.xxhash64(F.col(id_col).isNull(), t).alias("kth"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and fingerprint of each document."""
    rows = keyed(docs, id_col, text)
    tiers = vocabulary(rows)
    filled = described_by(rows.repartition(*[F.col(k) for k in KEY]), "text", tiers)
    return rows.join(filled, KEY, "left").select("doc_id", "text", printed(F.col("slots"), F.col("text")).alias("fingerprint"))


def edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and their likeness.

    The edited text has its last third replaced by the head of the next document in
    descending order of ids; the first one follows the last one.
    """
    rows = keyed(docs, id_col, text)
    tiers = vocabulary(rows)
    # Who follows whom: over ids and lengths only.
    ids = rows.select("doc_id", *KEY, "n_chars").distinct()
    order = ["doc_id", *KEY]
    ids = materialize(ids.withColumn("me", F.struct(*KEY)))
    top = ids.agg(F.max_by("me", F.struct(F.col("doc_id").isNotNull(), *order)).alias("top")).first()["top"]
    if top is None:
        first = F.lit(None).cast("struct<kid:bigint,kth:bigint>")
    else:
        first = F.struct(F.lit(top["kid"]).alias("kid"), F.lit(top["kth"]).alias("kth"))
    linked = range_scan(ids, [], order, [Lag("next", "me")]).withColumn("next", F.coalesce("next", first))
    third = F.floor(F.col("n_chars") / 3).cast("long")
    asked = materialize(linked.select(F.col("next.kid").alias("kid"), F.col("next.kth").alias("kth"), F.col("kid").alias("for_id"), F.col("kth").alias("for_th"), third.alias("take")))

    # Texts are shuffled once by key. Whatever reads them takes the same columns, so
    # that the terms, the heads and the edited texts share that one exchange.
    own = rows.select(*KEY, "text").repartition(*[F.col(k) for k in KEY])
    filled = described_by(own, "text", tiers)
    n = F.length("text")
    described = own.groupBy(*KEY).agg(F.max("text").alias("text")).join(filled, KEY, "left")
    heads = described.join(asked, KEY).select(F.col("for_id").alias("kid"), F.col("for_th").alias("kth"), F.concat_ws("\n", printed(F.col("slots"), F.col("text")), F.left("text", F.col("take").cast("int"))).alias("sent"))
    # Fingerprint and head travel as one column: both readers of the exchange need all of it.
    heads = heads.repartition(*[F.col(k) for k in KEY])
    head = F.expr("substring(sent, instr(sent, '\n') + 1)")
    both = described.join(heads, KEY).withColumn("edited", F.concat(F.left("text", n - F.floor(n / 3).cast("int")), head))
    changed = described_by(both.select(*KEY, "edited"), F.col("edited"), tiers).withColumnRenamed("slots", "edited_slots")
    prints = both.join(changed, KEY, "left").select(
        *KEY, n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.substring_index("sent", "\n", 1).alias("next_fingerprint"),
        printed(F.col("slots"), F.col("text")).alias("fingerprint"), printed(F.col("edited_slots"), F.col("edited")).alias("edited_fingerprint"),
    )
    # Back to rows: a row that repeats an id and a text has the same result.
    return rows.select("doc_id", *KEY).join(prints, KEY).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
