"""Brute force, round trips, edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import bpe, common, imatch, kdtree, lines, mixing, passages, pii, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rnd():
    return random.Random(5)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def odd_rows():
    return [(1, None, "a"), (2, "", None), (None, "one two three", "a"), (3, "one two three", "b"), (3, "one two three", "b"), (4, "x " * 3000, "b"), (5, " \n\t ", "a")]


OPERATORS = {
    "mixing": lambda d: mixing.taken(*mixing.mix(d)),
    "apply_mix": mixing.apply_mix,
    "bpe": lambda d: bpe.decode(bpe.encode(d)),
    "imatch": imatch.edited,
    "pii": pii.find,
    "lines": lambda d: lines.deduplicate(d, gone="gone"),
    "passages": passages.repeated,
    "simhash": simhash.near_duplicates,
    "simhash_keep": simhash.deduplicate,
    "quality": lambda d: quality.score_texts(d, quality.fit(quality.statistics_of(d).withColumn("label", F.lit(None).cast("int")))),
    "toxicity": lambda d: toxicity.score(d, toxicity.Model(0.0, {"one": 1.0})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_and_odd_rows(spark, name):
    run = OPERATORS[name]
    assert run(docs(spark, [])).count() == 0
    clash = docs(spark, odd_rows()).withColumn("key", F.lit(1)).withColumn("IDS", F.lit("x")).withColumn("term", F.lit("y"))
    got = run(clash).collect()
    if name in ("bpe", "pii", "lines", "quality", "toxicity", "simhash", "imatch", "mixing"):
        assert len(got) == 7


def test_bpe_equals_the_library(spark, rnd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    alphabet = "abcdehinorst'é ΣÉ.,!?-_#19½漢\n\x1c<|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts += ["a" * 20000, "don't stop<|endoftext|>Now <|startoftext|>", "İstanbul ΑΣ", ""]
    spec = open(bpe.default_path(), encoding="utf-8").read()
    own, forgetful = bpe.Bpe(spec), bpe.Bpe(spec, entries=2)
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert forgetful.encode(t) == own.encode(t)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want, t[:50]
        assert own.decode(own.encode(t)) == tok.decode(want, skip_special_tokens=False)


def test_bpe_handles_the_new_words_of_a_batch_together(rnd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    spec = open(bpe.default_path(), encoding="utf-8").read()
    own, alone, forgetful = bpe.Bpe(spec), bpe.Bpe(spec), bpe.Bpe(spec, entries=2)
    parts = ["th", "e", "ing", "a", "tion", "é", "ß", "qu", "x", "ss", "ed", "st", "r", "ñ", "漢"]
    ends = ["", "", ".", "!!", ",", "'s", "'", "%%%", "19", "½", "-a", "<|endoftext|>"]
    word = lambda: "".join(rnd.choices(parts, k=rnd.randrange(1, 12))) + rnd.choice(ends)
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 60))) for _ in range(200)] + [None, "", "  ", "<|endoftext|>", "th" * 500]
    one_by_one = []
    own.encode_symbols = lambda w, f=own.encode_symbols: one_by_one.append(w) or f(w)
    got = own.encode_all(texts)
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == (tok.encode(t, add_special_tokens=False).ids if t else [])
        assert ids == alone.encode(t) == forgetful.encode(t)
    assert own.encode_all(texts) == got == forgetful.encode_all(texts)
    assert own.encode_all([]) == []
    # Only long words, and the few words that are left at the end, are handled alone.
    assert sum(len(w) <= bpe.LONG for w in one_by_one) < bpe.FEW
    assert max(len(forgetful.of_chunk.young), len(forgetful.of_chunk.old)) <= 2


def test_bpe_tables_of_whole_numbers(rnd):
    keys = np.array(rnd.sample(range(10**9), 3000) + [0])
    table = bpe.Table(keys, np.arange(3001))
    assert table.get(keys).tolist() == list(range(3001))
    assert (table.get(np.setdiff1d(np.arange(5000), keys)) == -1).all()
    assert bpe.Table(np.array([], np.int64), np.array([], np.int64)).get(np.arange(9)).tolist() == [-1] * 9


def test_mixing_targets_and_tree(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    # a is capped at 30; the rest of 1110 words is shared 2 : 1, null capped at 300.
    assert got["a"] == 30 and got[None] == 300 and abs(got["b"] - 780) < 1e-9
    quotas = np.array([700, 0, 45, 255])
    parts = mixing.split(quotas, 13, 0, 13, 3)
    assert sorted(parts) == list(range(13)) and (sum(p[0] for p in parts.values()) == quotas).all()
    assert {int(p[0].sum()) for p in parts.values()} <= {76, 77}
    assert sorted(mixing.permuted(np.arange(1000), 1000, 9)) == list(range(1000))
    rows = [(i, "w " * (i % 7 + 1), "s%d" % (i % 3)) for i in range(300)]
    placed, pieces = mixing.mix(docs(spark, rows), block_words=50, shard_blocks=4)
    taken = mixing.taken(placed, pieces).collect()
    by = {}
    for r in taken:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(t - want) <= 1 for t, want in by.values())
    words = sum(len(r["text"].split()) for r in mixing.apply_mix(docs(spark, rows), block_words=50, shard_blocks=4).collect())
    assert words == sum(r["taken"] for r in taken)


def test_toxicity_swaps(rnd):
    """A group's name that goes with toxic labels by chance loses its weight under the penalty."""
    base = ["thing%d" % i for i in range(40)]
    rows = []
    for i in range(400):
        toxic = i % 2
        words = {rnd.choice(base) for _ in range(5)} | ({"idiot"} if toxic and i % 4 == 1 else set()) | ({"muslims"} if toxic else set())
        rows.append((toxic, words))
    names = sorted({f for _, w in rows for f in toxicity.features_of(w | {"christians"})})
    at, swap = {f: i for i, f in enumerate(names)}, toxicity.swaps()

    def table():
        out = []
        for y, w in rows:
            other = toxicity.swapped(w, swap)
            out.append({"y": y, "own": [at[f] for f in toxicity.features_of(w)], "other": None if other is None else [at[f] for f in toxicity.features_of(other) if f in at]})
        return out

    free = toxicity._train(table(), names, 0.0, 0.0, 1.0, 300, 200, 200)
    held = toxicity._train(table(), names, 0.0, 50.0, 1.0, 300, 200, 200)
    gap = lambda m: abs(m.score("muslims are here") - m.score("christians are here"))
    assert gap(held) < 0.3 * gap(free) and held.score("you idiot") > held.score("you there")


def test_imatch_band_and_likeness(spark):
    rows = [(i, " ".join(f"t{(i * 7 + j) % 97}" for j in range(30)), "a") for i in range(60)]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in imatch.edited(d).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, _) in enumerate(order):
        nxt, cut = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1
    df = {}
    for _, t, _ in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    band = {w for w, n in df.items() if 60 * np.exp(-2.0) <= n <= 60 * np.exp(-1.0)}
    kept = imatch.lexicon(imatch.keyed(d), low=1.0, high=2.0).count()
    assert kept == len(band)


def test_pii_base_and_disguise(rnd):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(s):
        out = []
        for kind, rx in plain.items():
            for m in re.finditer(rx, s):
                d = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d or "1"), "phone": 10 <= len(d) <= 15}[kind]
                if good:
                    out.append((kind, *m.span()))
        return pii.ordered(out)

    for _ in range(4000):
        s = "".join(rnd.choice("a.@1-+ ()0.5 9@x_") for _ in range(rnd.randrange(60)))
        assert pii.base_spans(s) == brute(s), s
    for text, found in [("to jo.x [at] mail [dot] net !", "jo.x [at] mail [dot] net"), ("plus one nine eight eight five five five two four eight five.", "plus one nine eight eight five five five two four eight five"), ("jоhn＠exаmple．com", "jоhn＠exаmple．com"), ("host one nine two dot one dot one dot seven", "one nine two dot one dot one dot seven")]:
        base, spans = pii.all_spans(text)
        assert not base and [text[s:e] for _, s, e in spans] == [found]
    assert pii.all_spans("look at the sea. un deux trois") == ([], [])
    assert len(pii.base_spans("1" * 200_000)) == 0


def test_lines_brute_force(spark, rnd):
    pool = ["a", "bb", "a long line of more than twenty", "   ", "", "another long line of text, yes", "c c"]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.8 else f"only here {rnd.random()}" for _ in range(rnd.randrange(1, 14))), "a") for i in range(60)]
    got = {r["doc_id"]: r for r in lines.deduplicate(docs(spark, rows), min_chars=5, gone="gone").collect()}
    seen = set()
    for i, t, _ in rows:
        full = t.split("\n")
        body = [(k, x) for k, x in enumerate(full) if x.strip(" ")]
        gone = set()
        for s in range(len(body)):
            for e in range(s + 1, len(body) + 1):
                run = tuple(x for _, x in body[s:e])
                if run in seen and sum(len(x.strip(" ")) for x in run) >= 5:
                    gone |= {k for k, _ in body[s:e]}
                seen.add(run)
        assert got[i]["gone"] == sorted(gone)
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(full) if k not in gone)


def test_passages_brute_force(spark, rnd):
    words = [f"w{i}" for i in range(50)]
    parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(20, 90))) for _ in range(12)]
    rows = [(i, "  ".join(rnd.choice(parts) if rnd.random() < 0.5 else f"u{i} v{rnd.random()}" for _ in range(5)), "a") for i in range(40)]
    got = {}
    for r in passages.repeated(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    first, want = {}, {}
    for i, t, _ in rows:
        w = t.split()
        for s in range(len(w) - 49):
            k = tuple(w[s : s + 50])
            if k in first:
                own = want.setdefault(i, [])
                if own and s <= own[-1][1]:
                    own[-1] = (own[-1][0], s + 50)
                else:
                    own.append((s, s + 50))
            else:
                first[k] = i
    assert {k: sorted(v) for k, v in got.items()} == want
    assert passages.without("a b  c d", [(1, 3)]) == "a d"


def test_kdtree_brute_force(spark, rnd):
    rows = [(i, [rnd.choice([-0.5, 0.1, 0.25, 0.7]) for _ in range(6)]) for i in range(400)] + [(500 + i, [0.1] * 6) for i in range(200)]
    rows += [(1000, None), (1050, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (None, [0.5] * 6), (1150, []), (50, rows[50][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1))
    got = {}
    for r in kdtree.top_k(frame, F.col("vec_id") % 50 == 0, shard_rows=64, query_rows=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(256 * np.array(v)) for i, v in rows[:600]}
    want = {}
    for q in [i for i in good if i % 50 == 0]:
        best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:5]
        want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_simhash_covering_and_large_buckets(spark, rnd):
    masks = simhash.covering_masks()
    for _ in range(2000):
        diff = sum(1 << b for b in rnd.sample(range(64), 3))
        assert any(not diff & m for m in masks)
        mask = rnd.choice(masks)
        free = [i for i in range(64) if not mask >> i & 1]
        inside = sum(1 << b for b in rnd.sample(free, 3))
        assert any(not inside & m for m in simhash.finer(mask))
    base = rnd.getrandbits(62)
    prints = sorted({base ^ sum(1 << b for b in rnd.sample(range(20), rnd.randrange(5))) for _ in range(400)} | {rnd.getrandbits(62) for _ in range(100)})
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.classes(frame, most=16).collect()}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {p: find(i) for i, p in enumerate(prints)}


def test_quality_separates(spark):
    good = [(i, "Some plain words in a row, and then others follow them %d." % (i * 37) * (1 + i % 4), "a") for i in range(80)]
    bad = [(100 + i, "BUY!!! $$$ NOW### %d " % i * (5 + i % 9), "a") for i in range(80)]
    d = quality.statistics_of(docs(spark, good + bad)).withColumn("label", (F.col("doc_id") < 100).cast("int"))
    model = quality.fit(d.where("doc_id % 2 = 0"))
    rows = quality.score(d.where("doc_id % 2 = 1"), model).collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] < 100) for r in rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    d = raw = common.table(spark, sf, "documents")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == raw.columns
        rows = out.collect()
        before = d.collect()
        ids = {r["doc_id"] for r in before}
        assert rows and {r["doc_id"] for r in rows} <= ids
        if name == "line dedup":
            assert len(rows) == len(before)
        if name == "near-dedup":
            assert len({r["doc_id"] for r in rows}) == len(rows)
        d = spark.createDataFrame(rows, raw.schema)
    last = P.STAGES[-1][1](spark, d, sf).collect()
    own = bpe.Bpe(open(bpe.default_path(), encoding="utf-8").read())
    assert sorted(bytes(r["ids"]) for r in last) == sorted(own.encode(r["text"]) for r in d.collect())
