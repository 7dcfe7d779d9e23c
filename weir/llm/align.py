"""Alignment of two tokenizers by skipping along diagonals.

Both tokenizers cut the same bytes, so a token is known by the offset of its end. The
two lists of ends are walked together at the current shift between their indices. As
long as the ends agree the tokens are one to one: windows of 8, 16, 32, ... ends are
compared as raw bytes, and the first difference is found by halving the window that
differs. An irregular group, where the ends part, is resolved locally: the side that is
behind steps on until both end at the same place; the steps are the group's links and
its sizes give the new shift.

Token bytes must give back the text: a text is tokenized with one leading blank, and
a text whose tokens of either side do not join to it has no tokens. So have null
and empty texts. Rows are handled one by one, so repeated rows and ties get equal
results and an empty table stays empty. Columns of the input stay, unless they have
the name of a result.

``scored`` weighs links by how often the id pair is linked in the whole corpus. The
``FREQUENT`` most frequent pairs are few by definition and travel to the tasks; every
other pair is rarer than all of those, so no key is hot in the join of the rest.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import stored, with_columns

# Pairs whose counts travel to the tasks: at most 25 bytes each.
FREQUENT = 65_536
FIRST = 4
# Code points below this one belong to the same classes in all versions of Unicode in use.
SETTLED = re.compile("[^\\x00-\\u024f]")
# A pair of ids as one long: id of A times this, plus id of B.
PAIR = 1 << 31
# Fixed value: the pattern that cuts a text before the merges of the byte-level vocabulary.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def links(la: list[int], lb: list[int]) -> tuple[list[list[int]], list[list[int]], list[int], list[int]]:
    """Stretches, groups and links of two strictly rising lists of ends with the same last end.

    Stretches are three lists (i, j, run): ``run`` one-to-one groups from tokens i and j on. Irregular
    groups are two lists (i, j) of their first tokens. Links of irregular groups are two lists of indices.
    """
    na, nb = len(la), len(lb)
    at_a, at_b, runs, first_a, first_b, of_a, of_b = [], [], [], [], [], [], []
    i = j = 0
    while i < na:
        s, t, window = i, j, FIRST
        while la[i] == lb[j]:
            a, b = la[i : i + window], lb[j : j + window]
            if a != b:  # the first difference lies in [low, high)
                low, high = 0, min(len(a), len(b))
                while high - low > FIRST:
                    mid = (low + high) // 2
                    if a[low:mid] == b[low:mid]:
                        low = mid
                    else:
                        high = mid
                while low < high and a[low] == b[low]:
                    low += 1
                i += low
                j += low
                break
            i += len(a)
            j += len(a)
            if len(a) < window or i >= na or j >= nb:
                break
            window *= 2
        if i > s:
            at_a.append(s)
            at_b.append(t)
            runs.append(i - s)
        if i >= na or j >= nb:
            break
        x, y = la[i], lb[j]
        first_a.append(i)
        first_b.append(j)
        of_a.append(i)
        of_b.append(j)
        while x != y:
            if x < y:
                i += 1
                x = la[i]
            else:
                j += 1
                y = lb[j]
            of_a.append(i)
            of_b.append(j)
        i += 1
        j += 1
    return [at_a, at_b, runs], [first_a, first_b], of_a, of_b


class Aligner:
    """Both tokenizers with the bytes, byte lengths and printed ids of their tokens."""

    def __init__(self, spec_a: str, spec_b: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_str(spec_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=spec_b)
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        data = json.loads(spec_a)
        names = [b""] * self.a.get_vocab_size()
        ranked = set(data["model"]["vocab"].values()) - {x["id"] for x in data.get("added_tokens", [])}
        for token, at in data["model"]["vocab"].items():
            if all(c in byte_of for c in token):
                names[at] = bytes(byte_of[c] for c in token)
        for added in data.get("added_tokens", []):
            names[added["id"]] = added["content"].encode()
        self.bytes_a = names
        b = self.b
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # Both engines give the same ids; the second is several times as fast. It has other Unicode tables.
        self.fast = tiktoken.Encoding("a", pat_str=PRETOKENS, mergeable_ranks={x: i for i, x in enumerate(names) if x and i in ranked}, special_tokens={})
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.entries = [f"{i}{end}" for i in range(len(names)) for end in ",|"] + [f"{i}{end}" for i in range(len(pieces)) for end in ",;"]

    def side_a(self, spaced: list[str]) -> list[list[int]]:
        slow = [t for t in spaced if SETTLED.search(t)]
        rest = iter([e.ids for e in self.a.encode_batch_fast(slow, add_special_tokens=False)] if slow else [])
        return [next(rest) if SETTLED.search(t) else self.fast.encode_ordinary(t) for t in spaced]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where either side does not give back the text."""
        spaced = [" " + t for t in texts]
        out = []
        for s, ia, ib in zip(spaced, self.side_a(spaced), self.b.encode(texts, num_threads=1) if texts else []):
            raw = s.encode()
            same = b"".join(map(self.bytes_a.__getitem__, ia)) == raw and b"".join(map(self.bytes_b.__getitem__, ib)) == raw
            out.append((ia, ib) if same and len(s) > 1 else ([], []))
        return out

    def row(self, ia: list[int], ib: list[int]) -> tuple:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, pair_links) of one text."""
        if not ia:
            return 0, 0, 0, 0, "", [], []
        wa, wb = np.array(ia, np.int64), np.array(ib, np.int64)
        stretches, irregular, of_a, of_b = links(np.cumsum(self.size_a[wa]).tolist(), np.cumsum(self.size_b[wb]).tolist())
        at, to, run = (np.array(x, np.int64) for x in stretches)
        # Places inside the stretches: 0, 1, 2, ... from each start.
        place = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        one_a, one_b = np.repeat(at, run) + place, np.repeat(to, run) + place
        link_a, link_b = np.concatenate([one_a, np.array(of_a, np.int64)]), np.concatenate([one_b, np.array(of_b, np.int64)])
        pairs, often = np.unique(wa[link_a] * PAIR + wb[link_b], return_counts=True)
        digest = hashlib.sha256(self.printed(wa, wb, np.concatenate([one_a, irregular[0]]), np.concatenate([one_b, irregular[1]]))).hexdigest()
        return len(ia), len(ib), len(one_a) + len(irregular[0]), len(link_a), digest, pairs, often

    def printed(self, wa: np.ndarray, wb: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> bytes:
        """The groups as ``a1,a2|b1;a3|b2,b3``, given the first tokens of each group."""
        group = []
        for ids, first in ((wa, first_a), (wb, first_b)):
            mark = np.zeros(len(ids) + 1, np.int64)
            mark[first.astype(np.int64)] = 1
            group.append((np.cumsum(mark[:-1]), np.append(mark[1:-1], 1)))  # number of the group, whether the token ends it
        # Tokens of A before those of B in each group; each is printed with what follows it.
        order = np.argsort(np.concatenate([2 * group[0][0], 2 * group[1][0] + 1]), kind="stable")
        entry = np.concatenate([2 * wa + group[0][1], 2 * (wb + len(self.bytes_a)) + group[1][1]])[order]
        return "".join(map(self.entries.__getitem__, entry.tolist()))[:-1].encode()


@functools.lru_cache(maxsize=2)
def _loaded(spec_a: str, spec_b: bytes) -> Aligner:
    return Aligner(spec_a, spec_b)


def default_paths() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


RESULT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, pair_links array<long>"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "pair_links"]
# Characters tokenized at a time.
_CHARS = 1 << 20


def align(df: DataFrame, text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Adds the counts and the digest of each whole text, and its distinct id pairs (A * 2^31 + B) with their links."""
    path_a, path_b = paths or default_paths()
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        # Vocabulary files of a few MB, so executors need no copy of them.
        spec = df.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series) -> pd.DataFrame:
        own = _loaded(*spec.value)
        out, waiting, size = [], [], 0

        def flush():
            out.extend(own.row(ia, ib) for ia, ib in own.tokens(waiting))
            waiting.clear()

        for t in texts:
            t = t or ""
            if size + len(t) > _CHARS and waiting:
                flush()
                size = 0
            waiting.append(t)
            size += len(t)
        flush()
        return pd.DataFrame(out, columns=NAMES)

    added = with_columns(df, __aligned=run(F.col(f"`{text}`")))
    low = {n.lower() for n in NAMES}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]
    return added.select(*kept, "__aligned.*")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in the corpus, and whether no pair of the same B id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.pair_links").alias("k"))
    counts = stored(each.groupBy("pair").agg(F.sum("k").alias("n")))
    b = F.pmod("pair", F.lit(PAIR))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return stored(counts.join(most, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def scored(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to aligned rows; ``pairs`` and ``pair_links`` go."""
    spark = aligned.sparkSession
    rows = stored(aligned.withColumn("__row", F.monotonically_increasing_id()))
    counts = pair_counts(rows)
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    hot = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def looked_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs in the frequent ones and whether they are there."""
        keys = hot.value[0]
        if not len(keys):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        return at, keys[at] == pairs

    @F.pandas_udf("n_best long, count_sum long")
    def known(pairs: pd.Series, often: pd.Series) -> pd.DataFrame:
        out = []
        for p, k in zip(pairs, often):
            at, there = looked_up(p)
            k = np.where(there, k, 0)
            _, n, best = hot.value
            out.append((int(k[best[at]].sum()) if len(n) else 0, int((k * n[at]).sum()) if len(n) else 0))
        return pd.DataFrame(out, columns=["n_best", "count_sum"])

    @F.pandas_udf("array<struct<pair: long, k: long>>")
    def rare(pairs: pd.Series, often: pd.Series) -> pd.Series:
        out = []
        for p, k in zip(pairs, often):
            left = ~looked_up(p)[1]
            out.append([{"pair": x, "k": y} for x, y in zip(p[left].tolist(), k[left].tolist())])
        return pd.Series(out, dtype=object)

    rest = rows.select("__row", F.explode(rare("pairs", "pair_links")).alias("x")).select("__row", "x.pair", "x.k").join(counts, "pair")
    sums = rest.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("__best"), F.sum(F.col("k") * F.col("n")).alias("__sum"))
    low = {"n_best", "count_sum", "pairs", "pair_links", "__row"}
    kept = [F.col(f"`{c}`") for c in aligned.columns if c.lower() not in low]
    first = rows.select("__row", *kept, known("pairs", "pair_links").alias("__known"))
    both = first.join(sums, "__row", "left")
    zero = F.lit(0).cast("long")
    return both.select(*kept, (F.col("__known.n_best") + F.coalesce("__best", zero)).alias("n_best"), (F.col("__known.count_sum") + F.coalesce("__sum", zero)).alias("count_sum"))
