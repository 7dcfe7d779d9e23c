"""Fits with few or no labels, fingerprints bit by bit, searches without rows or queries, reruns of a mix."""

import random

import xxhash
from pyspark.sql import functions as F

from weir.llm import kdtree, mixing, quality, queries, toxicity

from .test_llm import docs, odd_rows

RAW = "[^\\x20\\x09-\\x0D]+"


def labelled(spark, rows):
    return spark.createDataFrame(rows, "text string, label int")


def sentences(n, seed=1):
    rnd = random.Random(seed)
    mild, harsh = ["kind", "garden", "music", "travel"], ["stupid", "idiot", "hate", "trash"]
    return [(" ".join(rnd.choice(harsh if k % 2 and rnd.random() < 0.5 else mild) for _ in range(12)) + (" stupid" if k % 2 else ""), k % 2) for k in range(n)]


def test_toxicity_fit_separates_and_repeats(spark):
    rows = sentences(120)
    model = toxicity.fit(labelled(spark, rows))
    other = sentences(60, 2)
    got = toxicity.score(labelled(spark, other), model).collect()
    assert sum((r["score"] >= 0.5) == bool(r["label"]) for r in got) >= 58
    again = toxicity.fit(labelled(spark, rows[::-1]).repartition(5))
    for r, s in zip(got, toxicity.score(labelled(spark, other), again).collect()):
        assert abs(r["score"] - s["score"]) < 1e-9
    # Null and foreign labels take no part; repeated rows count as often as they occur.
    noisy = toxicity.fit(labelled(spark, rows + [("kind stupid", None), ("garden", 7)]))
    assert noisy.score("kind music") == model.score("kind music")


def test_toxicity_fit_without_a_class(spark):
    for rows, low in (([("a b", 1)] * 6, False), ([("a b", 0)] * 6, True), ([], None), ([("a", None), (None, None)], None)):
        model = toxicity.fit(labelled(spark, rows))
        for text in ("a b", "", None):
            score = model.score(text)
            assert 0 <= score <= 1 and (low is None or (score < 0.5) == low)


def test_quality_fit_without_a_class(spark):
    texts = docs(spark, [(k, f"some plain words number {k} in a row", "a") for k in range(12)] + odd_rows())
    for label in (0, 1):
        model = quality.fit(quality.statistics_of(texts).withColumn("label", F.lit(label)))
        scores = [r["score"] for r in quality.score_texts(texts, model).collect()]
        assert len(scores) == 19 and all(0 <= s <= 1 for s in scores)


def test_search_without_rows_or_queries(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [0.1, 0.2]), (2, [0.3, 0.1])], [(50, None), (100, [float("nan"), 1.0])]):
        assert kdtree.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).count() == 0


def brute_fingerprint(text):
    import re

    words = re.findall(RAW, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_fingerprints_bit_by_bit(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op9_simhash"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == brute_fingerprint(texts[r["doc_id"]]), r["doc_id"]


def test_reruns_of_a_mix_agree(spark):
    rnd = random.Random(9)
    rows = [(k, " ".join("w" for _ in range(rnd.randrange(40))), rnd.choice(["a", "b", "c", None])) for k in range(200)]
    first, second = (sorted(map(str, mixing.taken(*mixing.mix(docs(spark, r).repartition(n))).collect())) for r, n in ((rows, 3), (rows[::-1], 7)))
    assert first == second


def test_pieces_of_a_mix_cover_what_is_taken(spark):
    """Pieces of a document add up to its taken words, shards are full, and reruns place each piece alike."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 40)), "ab"[i % 2] if i % 5 else None) for i in range(400)], "doc_id long, text string, source string")

    def run():
        return {r["doc_id"]: (r["taken"], r["size"], [tuple(p) for p in r["pieces"]]) for r in mixing.taken(*mixing.mix(docs, block_words=16, shard_blocks=8)).collect()}

    got = run()
    assert len(got) == 400 and got == run()
    for taken, size, pieces in got.values():
        assert taken == sum(p[4] - p[3] for p in pieces) and all(0 <= p[3] < p[4] <= size for p in pieces)
    words = {}
    for _, _, pieces in got.values():
        for shard, _, _, low, high in pieces:
            words[shard] = words.get(shard, 0) + high - low
    # A shard has 8 blocks at most; only the last block of a source can be shorter.
    assert sorted(words) == list(range(len(words))) and max(words.values()) <= 8 * 16
    assert len({(p[0], p[1]) for _, _, ps in got.values() for p in ps}) == sum(len(ps) for _, _, ps in got.values())
