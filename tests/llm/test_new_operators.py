"""Whitening, tokenizer alignment and divergence rules against brute force, with odd rows and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import align, divergence, whiten

from .test_llm import docs, odd_rows

VECTORS = "vec_id long, embedding array<double>, X string, dim int"


# --- whitening --------------------------------------------------------------


def rotated(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [
    list(range(40, 0, -1)), [5.0, 5.0, 5.0, 2.0, 1.0, 1.0], [1 + 1e-9 * i for i in range(6)] + [3.0, 1e-3, 1e-3 + 1e-12],
    [1e6, 1.0, 1 - 1e-10, 1e-6, 0.0, 0.0], [2.0] * 8, [0.0] * 3, [7.0],
])
def test_refined_eigenvectors(values):
    a = rotated(values, len(values))
    a = (a + a.T) / 2
    e, x = whiten.eigen(a)
    size = max(1e-300, np.abs(a).max())
    assert (np.diff(e) <= 0).all() and np.abs(e - np.sort(np.linalg.eigvalsh(a))[::-1]).max() <= 1e-13 * size * len(e)
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-14
    assert np.abs(a @ x - x * e).max() <= 4e-15 * size * len(e)


def test_close_pair_is_told_apart():
    """Two eigenvalues 1e-11 apart: single precision mixes their vectors, the refined ones are right to their gap."""
    d = np.array([3.0, 1 + 1e-11, 1.0, 0.5])
    e, x = whiten.eigen(np.diag(d))
    assert np.abs(np.abs(x) - np.eye(4)).max() < 1e-15 and (e == np.sort(d)[::-1]).all()


def brute_whiten(rows):
    x = np.array([np.floor(64 * np.array(v, float)) + 1_000_000 for _, v in rows])
    n, s = len(x), [int(c) for c in x.sum(0)]
    c = x - np.array(s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    z = c @ u[:, ::-1] / np.sqrt(e[::-1])
    return n, [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x], z[:, :32], (e[::-1] / e.sum())[:32]


def test_whitening_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=40) * np.linspace(1, 9, 40)).tolist()) for i in range(300)]
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    odd = [(900, None), (901, [math.nan] + [0.0] * 39), (902, [None] + [0.0] * 39), (903, [math.inf] + [0.0] * 39), (904, [])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], VECTORS)
    got = whiten.whiten(whiten.whole_vectors(frame)).toPandas()
    n, dev, z, share = brute_whiten(rows)
    assert len(got) == 302 * 32 and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for k in (0, 11, 300, 301):
        own = got[got.vec_id.isna()] if rows[k][0] is None else got[got.vec_id == rows[k][0]][:32]
        own = own.sort_values("component")
        assert own.component.tolist() == list(range(1, 33)) and (own.deviation == dev[k]).all()
        assert np.abs(np.abs(own.whitened) - np.abs(z[k])).max() < 1e-9 and np.abs(own.explained / share - 1).max() < 1e-10
    sign = np.sign((got.sort_values(["component", "deviation"]).whitened.to_numpy().reshape(32, -1) * z[np.argsort(dev, kind="stable")].T))
    assert (np.abs(sign.sum(1)) >= 300).all()  # one sign for all rows


def test_whitening_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whiten.whiten(whiten.whole_vectors(empty)).count() == 0
    # One vector alone has no variance; lengths are fitted apart; huge entries stay exact.
    rows = [(1, [0.5, 0.25, 1.0])] + [(10 + i, [float(i % 2), float(i // 2)]) for i in range(4)] + [(20 + i, [i * 1e9]) for i in range(3)]
    got = whiten.whiten(whiten.whole_vectors(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS))).toPandas()
    assert got[got.vec_id == 1].whitened.isna().all() and (got[got.vec_id == 1].deviation == 0).all()
    two = got[got.vec_id.between(10, 19)]
    assert (two.n == 4).all() and np.allclose(np.abs(two.whitened), 1) and two.deviation.tolist() == [4 * 4 * 2 * 32 * 32] * 8
    three = got[got.vec_id >= 20]
    assert np.allclose(np.sort(three.whitened.abs()), [0, math.sqrt(1.5), math.sqrt(1.5)])
    assert sorted(three.deviation.dropna()) == [0]  # (3 * 64e9)^2 is beyond a long


# --- alignment --------------------------------------------------------------


def aligner():
    a, b = align.default_paths()
    return align.Aligner(open(a, encoding="utf-8").read(), open(b, "rb").read())


def brute_links(ea, eb):
    sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
    return [(i, j) for i in range(len(ea)) for j in range(len(eb)) if sa[i] < eb[j] and sb[j] < ea[i]]


def test_diagonal_walk_equals_all_overlaps():
    rnd = random.Random(2)
    for turn in range(400):
        n = rnd.choice([1, 2, 9, 40, 200])
        grid = sorted(rnd.sample(range(1, 3 * n + 2), n))
        # The second list drops and adds a few ends; the last end is common.
        ea = grid
        eb = sorted({e for e in grid if rnd.random() < rnd.choice([0.6, 0.97])} | {rnd.randrange(1, grid[-1] + 1) for _ in range(rnd.randrange(3))} | {grid[-1]})
        stretches, groups, la, lb = align.links(ea, eb)
        straight = [(i + k, j + k) for i, j, run in zip(*stretches) for k in range(run)]
        assert sorted([*straight, *zip(la, lb)]) == brute_links(ea, eb)
        # Every group begins where both sides ended together.
        ends = [0, *[e for e in ea if e in set(eb)]][:-1]
        assert sorted([*straight, *zip(*groups)]) == [(ea.index(e) + 1 if e else 0, eb.index(e) + 1 if e else 0) for e in ends]


def test_both_engines_agree(small):
    """The fast engine gives the ids of the library on all texts of a table and on odd ones."""
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{small.replace('0.001', '0.01')}/documents.parquet' WHERE text <> ''").fetchall()]
    texts += ["  a  b ", "\n\n x", "\u00a0 nbsp", "▁▁ a▁b", "don't  STOP 12 345..", "漢字 🙂 é", "<s> </s> <unk> <0x0A>", "\u2028x", "x" * 3000, " ", "\t", "ab " * 2000]
    own = aligner()
    spaced = [" " + t for t in texts]
    assert own.side_a(spaced) == [e.ids for e in own.a.encode_batch(spaced, add_special_tokens=False)]


def test_alignment_of_a_corpus(spark):
    rnd = random.Random(6)
    alphabet = "etaoin shrdlu é漢字🙂\n  <|endoftext|> </s> <0x41> ½ 123 ... Don't"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(60)]
    texts += [None, "", " ", "the the the", "the the the", "x" * 5000, "▁ low line", "a\u0000b", "<|endoftext|> and <s> are plain text", "é ﬁ Ａ"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    frame = docs(spark, rows).withColumn("N_A", F.lit("clash")).withColumn("pair", F.lit(1))
    own = aligner()
    want, pairs = {}, Counter()
    for i, t, _ in rows:
        raw = (" " + (t or "")).encode()
        ia, ib = ([], []) if not t else (own.a.encode(" " + t, add_special_tokens=False).ids, own.b.encode(t))
        ba, bb = [own.bytes_a[k] for k in ia], [own.bytes_b[k] for k in ib]
        if b"".join(ba) != raw or b"".join(bb) != raw:
            want[i] = ([], [], [], "")
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = [0, *[e for e in ea if e in set(eb)]]
        groups = ["|".join(",".join(str(k) for k, e in zip(ids, ends) if s < e <= t2) for ids, ends in ((ia, ea), (ib, eb))) for s, t2 in zip(cuts, cuts[1:])]
        links = [(ia[x], ib[y]) for x, y in brute_links(ea, eb)]
        pairs.update(links)
        want[i] = (ia, ib, links, groups)
    most = {}
    for (_, b), n in pairs.items():
        most[b] = max(most.get(b, 0), n)
    assert sum(1 for w in want.values() if w[0]) > 30
    for frequent in (3, 65_536):
        got = {r["doc_id"]: r for r in align.scored(align.align(frame), frequent).collect()}
        assert len(got) == len(rows)
        for i, (ia, ib, links, groups) in want.items():
            r = got[i]
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ia else ""
            assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (len(ia), len(ib), len(groups), len(links), digest)
            assert r["n_best"] == sum(pairs[p] == most[p[1]] for p in links) and r["count_sum"] == sum(pairs[p] for p in links)
    assert align.scored(align.align(docs(spark, []))).count() == 0


# --- divergence -------------------------------------------------------------


def brute_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside), failed


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_divergence_measures_and_verdicts(spark):
    rnd = random.Random(8)
    good = [(i, prose(rnd, rnd.randrange(60, 300)), "a") for i in range(40)]
    shout = [(100 + i, prose(rnd, 100).upper(), "a") for i in range(3)]
    signs = [(110 + i, " ".join(f"{w}$$$" for w in prose(rnd, 100).split()), "a") for i in range(3)]
    other = [(120, " ".join("".join(rnd.choice("qrstuvw") for _ in range(6)) for _ in range(200)), "a")]
    odd = odd_rows() + [(130, "a b c\u000bd e\n\n x\r\n x\r\n a b c é漢🙂 |<>", "a"), (131, "w " * 9000, "a"), (132, "a b a b a b c", "a"), (133, "\n".join(["one two three four five"] * 20), "a")]
    rows = good + shout + signs + other + odd
    frame = docs(spark, rows).withColumn("KEPT", F.lit("x")).withColumn("kind", F.lit("y")).withColumn("ref_lang", F.lit("z"))
    got = divergence.judge(frame).collect()
    assert len(got) == len(rows)
    key = lambda i, t: (i is None, i or 0, t or "")
    for r, (i, t, _) in zip(sorted(got, key=lambda r: key(r["doc_id"], r["text"])), sorted(rows, key=lambda x: key(x[0], x[1]))):
        assert (*[r[c] for c in divergence.MEASURES], r["base_failed"]) == brute_base(t), t
        if i is not None and i < 100 and (i, t, "a") in good:
            assert r["kept"] and r["word_distance"] < 0.2
        elif i is not None and 100 <= i <= 120:
            assert not r["base_failed"] and not r["kept"], i
    assert divergence.judge(docs(spark, [])).count() == 0
    # A language of few texts judges nobody.
    few = divergence.judge(docs(spark, shout + good[:5])).collect()
    assert all(r["kept"] and r["word_distance"] is None for r in few)


def test_divergence_distance_by_hand(spark):
    rnd = random.Random(9)
    rows = [(i, prose(rnd, 80) + " 12.5 É!", "a") for i in range(25)]
    refs = divergence.references(docs(spark, rows)).collect()
    assert len(refs) == 1
    weigh = Counter()
    cls = np.zeros(7)
    for _, t, _ in rows:
        w = t.lower().split()
        for x in w:
            weigh[x] += 10**9 // len(w)
        cls += [c * 10**9 // len(t) for c in classes(t)]
    top = sorted(weigh.items(), key=lambda x: (-x[1], x[0]))[:32]
    assert refs[0]["common"] == [w for w, _ in top]
    q = np.array([0, *[v for _, v in top]]) / sum(weigh.values())
    q[0] = 1 - q.sum()
    assert np.allclose(refs[0]["word_shares"], q) and np.allclose(refs[0]["class_shares"], cls / cls.sum())
    got = {r["doc_id"]: r for r in divergence.judge(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        w = t.lower().split()
        p = np.array([0.0, *[w.count(x) for x, _ in top]]) / len(w)
        p[0] = 1 - p.sum()
        assert abs(got[i]["word_distance"] - far(p, q, 33, len(w))) < 1e-9
        assert abs(got[i]["char_distance"] - far(np.array(classes(t)) / len(t), cls / cls.sum(), 7, len(t))) < 1e-9


def classes(t):
    out = []
    for c in ("[a-z]", "[A-Z]", r"[\x20\x09-\x0D]", r"[.,;:?!'\"()\-]", "[0-9]", r"[\x00-\x7F]"):
        out.append(len(re.findall(c, t)))
        t = re.sub(c, "", t)
    return [*out, len(t)]


def far(p, q, bins, n):
    m = (p + q) / 2
    side = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0, (side(p) + side(q)) / 2 - 3 * (bins - 1) / (8 * math.log(2) * n)))
