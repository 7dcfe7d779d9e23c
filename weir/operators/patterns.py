"""Frequent and maximal item patterns over additions and removals of baskets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..scale import BLOCK, DEFAULT_WIDTH, broadcast_if_small, dense_index, dense_int_index, parallelism
from ..session import materialize, run_dir

# Items of a basket whose subsets are expanded at a time.
CHUNK = 10
# Subsets of a basket, on average, up to which all are counted at once.
MEAN_SUBSETS = 256
# Items and baskets that a key of 64 bits tells apart: a mask of items over a position.
MASK_ITEMS, MASK_BASKETS = 48, 1 << 16
# Patterns that a task keeps for a segment of arrivals, and subsets that it makes at a time.
SEGMENT_PATTERNS, SEGMENT_ROWS = 1 << 20, 1 << 21


def dictionary_from_lines(lines: DataFrame, seq: str = "seq", word: str = "word") -> DataFrame:
    """word -> 0-based line number; a repeated word keeps its last line."""
    numbered = dense_int_index(lines.select(seq, word), seq, "id")
    return numbered.groupBy(word).agg(F.max("id").cast("int").alias("id"))


def dictionary_from_words(words: DataFrame, word: str = "word") -> DataFrame:
    """word -> position in the sorted list of distinct words."""
    indexed = dense_index(words.select(word).distinct(), [word], "id")
    return indexed.withColumn("id", F.col("id").cast("int"))


def join_dictionary(baskets: DataFrame, dictionary: DataFrame, keep: Sequence[str] = ("seq", "is_add")) -> DataFrame:
    """One row per known word of a basket: (keep..., word, id).

    The dictionary is measured and broadcast when small.
    """
    words = baskets.select(*keep, F.explode("words").alias("word"))
    return words.join(broadcast_if_small(dictionary), "word").select(*keep, "word", "id")


def basket_ids(baskets: DataFrame, dictionary: DataFrame, keep: Sequence[str] = ("seq", "is_add")) -> DataFrame:
    """Sorted distinct ids per basket; baskets without a known word vanish."""
    known = join_dictionary(baskets, dictionary, keep)
    return known.groupBy(*keep).agg(F.sort_array(F.collect_set("id")).alias("ids"))


def expand_subsets(df: DataFrame, items: str = "ids", keep: Sequence[str] = (), proper: bool = False) -> DataFrame:
    """One row (keep..., pattern) per non-empty subset, in bit-mask order up to ``CHUNK`` items.

    Items are taken ``CHUNK`` at a time: a row never holds more than 2^CHUNK
    arrays, however wide its basket is. The widest basket is measured first, and baskets
    beyond ``CHUNK`` items take a path of their own, so callers write ``df`` before.
    """
    widest = df.agg(F.max(F.size(items))).first()[0] or 0
    parts = [df.where(F.size(items) <= CHUNK), df.where(F.size(items) > CHUNK)] if widest > CHUNK else [df]
    done = []
    for part, most in zip(parts, (CHUNK, widest)):
        rows = part.select(*keep, F.col(items).alias("__items"), F.explode(A.subsets(f"slice({items}, 1, {CHUNK})" if most > CHUNK else items)).alias("pattern"))
        for first in range(CHUNK + 1, most + 1, CHUNK):
            rows = rows.withColumn("__part", F.slice("__items", first, CHUNK)).withColumn("__pick", F.explode(A.subsets("__part")))
            rows = rows.withColumn("pattern", F.concat("pattern", "__pick"))
        kept = F.size("pattern") > 0
        if proper:
            kept = kept & (F.size("pattern") < F.size("__items"))
        done.append(rows.where(kept).select(*keep, "pattern"))
    return reduce(DataFrame.unionByName, done)


def folded_baskets(baskets: DataFrame) -> DataFrame:
    """Equal baskets of one sign folded into (ids, is_add, rows)."""
    return baskets.groupBy("ids", "is_add").agg(F.count(F.lit(1)).alias("rows"))


def net_baskets(baskets: DataFrame, rows: str | None = None) -> DataFrame:
    """Equal baskets folded into (ids, n), n = additions minus removals; ``rows`` counts the baskets of a row."""
    each = F.col(rows) if rows else F.lit(1)
    sign = F.when(F.col("is_add"), each).otherwise(-each)
    return baskets.groupBy("ids").agg(F.sum(sign).alias("n")).where("n <> 0")


def pattern_counts(net: DataFrame) -> DataFrame:
    """(pattern, cnt) for every pattern with a positive count."""
    # Folded baskets are few bytes but many subsets. A partition count of our own
    # keeps small partitions from being merged into one task; the second key
    # keeps the planner from merging this shuffle into the one below.
    wide = net.repartition(parallelism(net.sparkSession), "ids", "n")
    rows = expand_subsets(materialize(wide), "ids", ["n"])
    return rows.groupBy("pattern").agg(F.sum("n").alias("cnt")).where("cnt > 0")


def _segment_sums(width: int, most: int, rows: int):
    """Folds baskets that come in arrival order into (pattern, block, total, low) per segment of a partition.

    ``low`` is the lowest running sum, 0 at most. A pattern is a mask over the items of its segment. A segment ends after
    ``width`` baskets, beyond ``most`` patterns or where its items are more than a mask holds; about ``rows`` subsets
    are made at a time. The helpers are inside so that they travel along: workers need not have the package.
    """

    def combined(masks, totals, lows):
        """Rows of equal masks, in their order, as one."""
        order = np.argsort(masks, kind="stable")
        masks, totals, lows = masks[order], totals[order], lows[order]
        starts = np.flatnonzero(np.concatenate([[True], masks[1:] != masks[:-1]]))
        before = np.cumsum(totals) - totals
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(masks))))
        return masks[starts], np.add.reduceat(totals, starts), np.minimum.reduceat(before + lows, starts)

    def subsets(bits, sizes):
        """Masks of all non-empty subsets and the position of their basket; a basket beyond ``rows`` subsets is alone and comes in pieces."""
        if len(sizes) == 1 and 1 << sizes[0] > rows:
            low = rows.bit_length() - 1
            piece = np.zeros(1, np.uint64)
            for bit in bits[:low]:
                piece = np.concatenate([piece, piece | bit])
            for high in range(1 << (len(bits) - low)):
                mask = np.bitwise_or.reduce([b for k, b in enumerate(bits[low:]) if high >> k & 1] or [np.uint64(0)])
                masks = piece | mask if high else piece[1:]
                yield masks, np.zeros(len(masks), np.uint64)
            return
        starts, made, at = np.cumsum(sizes) - sizes, [], []
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            items, masks = bits[starts[own][:, None] + np.arange(n)], np.zeros((len(own), 1), np.uint64)
            for k in range(n):
                masks = np.concatenate([masks, masks | items[:, k : k + 1]], axis=1)
            made.append(masks[:, 1:].ravel())
            at.append(np.repeat(own.astype(np.uint64), masks.shape[1] - 1))
        yield np.concatenate(made), np.concatenate(at)

    def fold(batches):
        from pyspark import TaskContext

        place, flushed, kind = TaskContext.get().partitionId() << 32, 0, None
        items, parts, held, merged, taken = {}, [], 0, 0, 0

        def flush():
            nonlocal items, parts, held, merged, taken, flushed
            if parts:
                masks, totals, lows = combined(*map(np.concatenate, zip(*parts)))
                ids = np.array(sorted(items))
                bits = np.array([items[i] for i in ids.tolist()], np.uint64)
                for k in range(0, len(masks), 1 << 16):
                    row, which = np.nonzero(masks[k : k + (1 << 16), None] & bits)
                    n = min(len(masks) - k, 1 << 16)
                    pattern = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(n + 1)).astype(np.int32), pa.array(ids[which], kind))
                    block = np.full(n, place + flushed, np.int64)
                    yield pa.RecordBatch.from_arrays([pattern, pa.array(block), pa.array(totals[k : k + n]), pa.array(lows[k : k + n])], ["pattern", "block", "total", "low"])
                flushed += 1
            items, parts, held, merged, taken = {}, [], 0, 0, 0

        def add(values, sizes, step):
            """The baskets in order, in runs that a segment's masks and ``rows`` allow."""
            nonlocal parts, held, merged, taken
            found = np.unique(values).tolist()
            if len(sizes) > 1 and (len(found) > MASK_ITEMS or len(sizes) > min(width, MASK_BASKETS) or (1 << sizes).sum() > rows):
                half = len(sizes) // 2
                cut = sizes[:half].sum()
                yield from add(values[:cut], sizes[:half], step[:half])
                yield from add(values[cut:], sizes[half:], step[half:])
                return
            if len(found) > MASK_ITEMS:
                raise ValueError(f"a basket of {len(found)} items has too many subsets to list")
            if taken + len(sizes) > width or len(items.keys() | set(found)) > MASK_ITEMS:
                yield from flush()
            for i in found:
                items.setdefault(i, 1 << len(items))
            taken += len(sizes)
            bits = np.array([items[i] for i in found], np.uint64)[np.searchsorted(found, values)]
            shift, last = np.uint64(MASK_BASKETS.bit_length() - 1), np.uint64(MASK_BASKETS - 1)
            for masks, at in subsets(bits, sizes):
                keys = masks << shift | at
                keys.sort()
                steps = step[(keys & last).astype(np.int64)]
                parts.append(combined(keys >> shift, steps, np.minimum(steps, 0)))
                held += len(parts[-1][0])
                if held > max(2 * merged, rows):
                    parts = [combined(*map(np.concatenate, zip(*parts)))]
                    held = merged = len(parts[0][0])
                    if merged > most:
                        kept = items
                        yield from flush()
                        items.update(kept)

        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("ids")), 0))
            if batch.num_rows:
                ids = batch.column("ids")
                kind = ids.type.value_type
                step = np.where(batch.column("is_add").fill_null(False).to_numpy(zero_copy_only=False), 1, -1)
                yield from add(ids.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), step)
        yield from flush()

    return fold


def clamped_pattern_counts(
    baskets: DataFrame, seq: str = "seq", width: int = DEFAULT_WIDTH, most: int = SEGMENT_PATTERNS, rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Counts in arrival order where a removal before its addition is forgotten.

    With running sum S, the clamped count is S minus the lowest value S ever
    had below 0. ``seq`` is a unique integer. Baskets (sorted distinct ids) are dealt out by ranges of arrivals, and a task sums up
    the subsets of its range as (sum, lowest running sum) per pattern, in segments of ``width`` arrivals or fewer; only
    these move, and a pattern's segments are put together in order.
    """
    spark = baskets.sparkSession
    folder = run_dir(spark, "arrivals")  # read twice: for the borders of the ranges and for the rows
    baskets.select("ids", seq, "is_add").write.parquet(folder)
    written = spark.read.schema(baskets.select("ids", seq, "is_add").schema).parquet(folder)
    # Few ranges, as a pattern moves once for each; some for every core, as they differ in subsets.
    ranges = min(parallelism(spark), 8 * spark.sparkContext.defaultParallelism)
    ordered = written.repartitionByRange(ranges, seq).sortWithinPartitions(seq).select("ids", "is_add")
    kind = baskets.schema["ids"].dataType.simpleString()
    sums = ordered.mapInArrow(_segment_sums(width, most, rows), f"pattern {kind}, block bigint, total bigint, low bigint")
    # The hash goes first: it is sorted by its value, an array only by comparing items.
    blocks = sums.select(F.xxhash64("pattern").alias("h"), "pattern", F.col("block").alias(BLOCK), "total", "low")
    before = Window.partitionBy("h", "pattern").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.select("h", "pattern", "total", (F.col("low") + F.coalesce(F.sum("total").over(before), F.lit(0))).alias("low"))
    last = placed.groupBy("h", "pattern").agg(F.sum("total").alias("total"), F.min("low").alias("low"))
    return last.select("pattern", (F.col("total") - F.least(F.lit(0), "low")).alias("cnt")).where("cnt > 0")


def frequent_items(net: DataFrame, threshold: int) -> DataFrame:
    items = net.select("n", F.explode("ids").alias("id"))
    return items.groupBy("id").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= threshold)


def prune_infrequent_items(net: DataFrame, threshold: int) -> DataFrame:
    """Drop items that no frequent pattern can hold, then fold equal baskets again.

    Exact while net multiplicities are not negative.
    """
    kept = net.withColumn("id", F.explode("ids")).join(frequent_items(net, threshold).select("id"), "id")
    # (ids, n) is unique per net basket, so it serves as the row key.
    rebuilt = kept.groupBy("ids", "n").agg(F.sort_array(F.collect_set("id")).alias("kept"))
    return rebuilt.groupBy(F.col("kept").alias("ids")).agg(F.sum("n").alias("n"))


def frequent_patterns(net: DataFrame, threshold: int, mean_subsets: int = MEAN_SUBSETS) -> DataFrame:
    """Patterns with count >= threshold, for baskets of any width.

    Baskets of frequent items with ``mean_subsets`` subsets or fewer, on average, are
    counted in one pass over their subsets. Wider ones go level by level: level k extends
    the frequent patterns of size k - 1 inside each basket by one larger frequent item,
    so rows grow with frequent patterns only.
    """
    pruned = prune_infrequent_items(materialize(net), threshold)
    base = materialize(pruned.repartition(parallelism(net.sparkSession), "ids", "n"))
    rows, subsets = base.agg(F.count(F.lit(1)), F.sum(F.pow(F.lit(2.0), F.size("ids")))).first()
    if rows and subsets <= rows * mean_subsets:
        every = expand_subsets(base, "ids", ["n"])
        return every.groupBy("pattern").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= threshold)
    step = base.select("ids", "n", F.explode("ids").alias("item")).select("ids", "n", F.array("item").alias("pattern"))
    found = None
    while True:
        counts = materialize(step.groupBy("pattern").agg(F.sum("n").alias("cnt")).where(F.col("cnt") >= threshold))
        if counts.isEmpty():
            break
        found = counts if found is None else found.unionByName(counts)
        held = step.join(counts.select("pattern"), "pattern", "left_semi")
        larger = F.filter("ids", lambda x: x > F.element_at("pattern", -1))
        step = held.withColumn("item", F.explode(larger)).select("ids", "n", F.array_append("pattern", F.col("item")).alias("pattern"))
        step = materialize(step)
    if found is None:  # no frequent item
        return step.groupBy("pattern").agg(F.sum("n").alias("cnt"))
    return found


def maximal_patterns(frequent: DataFrame) -> DataFrame:
    """Frequent patterns without a frequent proper superset.

    Every subset of a frequent pattern is frequent, so it is enough to strike
    out the patterns one item short of another frequent pattern.
    """
    frequent = materialize(frequent)
    covered = frequent.select(F.explode(A.drop_one_subsets("pattern")).alias("pattern")).distinct()
    return frequent.join(covered, "pattern", "left_anti")


def reference_counts(frequent: DataFrame) -> DataFrame:
    """(pattern, cnt, ref_count): frequent proper supersets of each frequent pattern."""
    frequent = materialize(frequent)
    refs = expand_subsets(frequent, "pattern", proper=True)
    refs = refs.groupBy("pattern").agg(F.count(F.lit(1)).alias("ref_count"))
    return frequent.join(refs, "pattern", "left").fillna(0, ["ref_count"])


def maximal_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pattern, is_maximal, cnt) for the patterns whose state changed."""
    b = before.select("pattern", F.col("cnt").alias("old_cnt"))
    a = after.select("pattern", F.col("cnt").alias("new_cnt"))
    both = b.join(a, "pattern", "full_outer").where(F.col("old_cnt").isNull() != F.col("new_cnt").isNull())
    return both.select("pattern", F.col("new_cnt").isNotNull().alias("is_maximal"), F.coalesce("new_cnt", F.lit(0)).alias("cnt"))


def pattern_words(patterns: DataFrame, dictionary: DataFrame, keep: Sequence[str] = ("cnt",)) -> DataFrame:
    """Patterns with their words in item order; an unknown id gives a null word."""
    items = patterns.select("pattern", *keep, F.posexplode("pattern").alias("pos", "id"))
    named = items.join(broadcast_if_small(dictionary.select("id", "word")), "id", "left")
    listed = named.groupBy("pattern", *keep).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return listed.select("pattern", *keep, F.transform("w", lambda x: x["word"]).alias("words"))
