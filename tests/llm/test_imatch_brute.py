"""Fingerprints and likeness of I-Match recomputed term by term."""

import math
import random
import re

from pyspark.sql import functions as F

from weir.llm import imatch

from .test_llm import docs


def hashes(spark, words):
    """xxhash64 of the words, and of the words' hashes with the seed, as Spark computes them."""
    frame = spark.createDataFrame([(w,) for w in sorted(words)], "w string").withColumn("t", F.xxhash64("w"))
    return {r["w"]: (r["t"], r["r"]) for r in frame.withColumn("r", F.xxhash64("t", F.lit(imatch.SEED))).collect()}


def array_hashes(spark, lists):
    frame = spark.createDataFrame([(i, list(x)) for i, x in enumerate(lists)], "i int, x array<bigint>")
    got = {r["i"]: r["h"] & 0xFFFFFFFF for r in frame.withColumn("h", F.hash("x", F.lit(imatch.SEED))).collect()}
    return {x: got[i] for i, x in enumerate(lists)}


def test_fingerprints_and_likeness(spark):
    rnd = random.Random(12)
    common = [f"c{i}" for i in range(12)]
    texts = []
    for i in range(90):
        few = i % 9 == 0
        words = [rnd.choice(common) for _ in range(3)] if few else [f"t{int(rnd.paretovariate(0.6)) % 400}" for _ in range(60)] + common
        texts.append(" ".join(words))
    texts += [texts[4], texts[4], "", None, "?!"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    texts = [t or "" for t in texts]
    split = lambda t: {w for w in re.split(r"[^\w]+|_", t.lower()) if w}
    low, high = math.exp(-imatch.LOW), math.exp(-imatch.HIGH)
    distinct = set(texts)
    df = {}
    for t in distinct:
        for w in split(t):
            df[w] = df.get(w, 0) + 1
    n = len(distinct)
    tier = {w: (0 if k <= n * low else math.ceil(math.log(k / (n * low)))) if k >= n * high else imatch.RARE for w, k in df.items()}
    order = sorted(range(len(rows)), reverse=True)
    after = {i: order[(k + 1) % len(order)] for k, i in enumerate(order)}
    edited = {i: texts[i][: len(texts[i]) - len(texts[i]) // 3] + texts[after[i]][: len(texts[i]) // 3] for i in after}
    known = hashes(spark, set(df) | {w for t in edited.values() for w in split(t)})

    def chosen(text):
        groups = {}
        for w in split(text):
            t, r = known[w]
            bits = ((r & (2**64 - 1)) >> 8) | 1 << 55
            depth = (bits & -bits).bit_length() - 1
            groups.setdefault(r % imatch.SLOTS, {}).setdefault((tier.get(w, imatch.RARE), -depth), set()).add(t)
        best = {s: (min(g), tuple(sorted(g[min(g)]))) for s, g in groups.items()}
        near = {s for s, (k, _) in best.items() if k[0] == 0}
        return {s: terms for s, (_, terms) in best.items() if len(near) < imatch.FEW or s in near}

    picks = {t: chosen(t) for t in {*texts, *edited.values()}}
    name = array_hashes(spark, sorted({x for p in picks.values() for x in p.values()}))
    prints = {t: {s: name[x] for s, x in p.items()} for t, p in picks.items()}

    def alike(a, b):
        if a == b or (prints[a] and prints[a] == prints[b]):
            return 1.0
        if not prints[a] or not prints[b]:
            return 0.0
        return sum(prints[a].get(s) == prints[b].get(s) and s in prints[a] for s in range(16)) / len(prints[a].keys() | prints[b].keys())

    got = {r["doc_id"]: r for r in imatch.edited(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and sum(1 for p in prints.values() if len(p) < 16) > 5
    for i, t in enumerate(texts):
        r = got[i]
        if prints[t]:
            assert r["fingerprint"] == "-".join(f"{prints[t][s]:x}" if s in prints[t] else "." for s in range(16))
        else:
            assert r["fingerprint"].startswith("text-")
        assert abs(r["near_edited"] - alike(t, edited[i])) < 1e-12 and abs(r["near_next"] - alike(t, texts[after[i]])) < 1e-12
