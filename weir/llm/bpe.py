"""BPE encoding and decoding by a dynamic programme over the prefixes of a word.

Every prefix of a word has exactly one BPE encoding, so it is enough to store
the last token of each prefix. A token that ends at a prefix is that last token
if it is compatible with the last token of the prefix before it: undoing the
merges of both tokens from the youngest on, no pair that meets at their border
would have merged earlier than the tokens themselves grew. An automaton over
all vocabulary entries lists the tokens that end at each prefix; the ids are
read off the back pointers. The work is linear in the length of a word, also
for a word of a million characters.

The new words of a batch of texts are handled together: the same table of last
tokens is filled for all of them at once, from the front, the longest token first.
A prefix from which no token leads on is marked and left by its back pointer, so
each prefix of a word is entered once.

Nulls and empty texts give no ids and the empty text. Rows are handled one by
one, so repeated rows and ties get equal results and an empty table stays empty.
"""

from __future__ import annotations

import functools
import gc
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

# Fixed values of the tokenizer format: white space and the pattern of words.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^" + SPACE + "\\p{L}\\p{N}]+"
END = "</w>"
# A run of these is one word; the apostrophe can start a word of its own.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# Bounds of the per-worker caches: entries of a generation, and characters of one entry.
CACHE_ENTRIES = 120_000
CACHE_CHARS = 48
# Last symbols of words live in a plane of their own, so each symbol is one character.
LAST = 0x10000
# Texts are encoded in groups of so many characters (one text at least), of fewer where caches
# are small: so many for each entry. Words up to LONG bytes are encoded together, if there are FEW or more.
GROUP_CHARS, ENTRY_CHARS = 1 << 18, 13
LONG, FEW = 64, 32


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Recent:
    """A bounded map in two generations: entries that nobody asks for go with the older one."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def get(self, key):
        """A value of the older generation moves to the younger one."""
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.entries:
            self.young, self.old = {}, self.young
        self.young[key] = value

    def put_all(self, items: dict) -> None:
        """Put many at once; those beyond the bound are not kept."""
        if len(items) > self.entries:
            items = dict(itertools.islice(items.items(), self.entries))
        if len(self.young) + len(items) > self.entries:
            self.young, self.old = {}, self.young
        self.young.update(items)


class Table:
    """A fixed map of whole numbers from 0 on, for arrays of keys; -1 for those it does not have."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        at = slots(keys, self.bits)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, at = keys[rest], values[rest], self._next(at[rest])

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = slots(keys, self.bits)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        at = at[todo]
        while len(todo):
            at = self._next(at)
            found, wanted = self.keys[at], keys[todo]
            out[todo] = np.where(found == wanted, self.values[at], -1)
            more = (found != wanted) & (found >= 0)
            todo, at = todo[more], at[more]
        return out


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The place of each key among 2 ** bits: the top bits of a product with an odd number."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Bpe:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, spec: str, entries: int = CACHE_ENTRIES):
        import ahocorasick
        import regex

        data = json.loads(spec)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [a + b for a, b in merges]
        grown = set(made)
        if len(grown) != len(made):
            raise ValueError("two merges give the same token")
        single = [t for t in vocab if t not in grown]
        # Tokens are numbered by age: single symbols first, then in order of their merges.
        names = single + made
        age = {t: i for i, t in enumerate(names)}
        self.single = len(single)
        self.ids = [vocab[t] for t in names]
        none = list(range(self.single))
        self.left = none + [age[a] for a, _ in merges]
        self.right = none + [age[b] for _, b in merges]
        self.count = len(names)
        self.pairs = {age[a] * self.count + age[b]: self.single + i for i, (a, b) in enumerate(merges)}
        self.known = Recent(entries)

        ok = [True] * self.count
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = [0] * self.count
        for t, name in enumerate(names):
            if t >= self.single:  # a token that BPE never leaves standing is no candidate
                ok[t] = ok[self.left[t]] and ok[self.right[t]] and self._grows(t)
            if ok[t]:
                key = name[:-5] + chr(ord(name[-5]) + LAST) if name.endswith(END) and len(name) > 4 else name
                self.automaton.add_word(key, t)
                self.length[t] = len(key)
        self.automaton.make_automaton()

        self.specials = {a["content"]: a["id"] for a in data.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.words = regex.compile(WORDS)
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.odd = regex.compile("[\\x1c-\\x1f]")
        self.symbols = byte_symbols()
        self.names = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for name, i in [*vocab.items(), *self.specials.items()]:
            self.names[i] = name
        # A word by itself is a chunk too, so one cache holds both.
        self.of_chunk = Recent(entries)
        self.group_chars = min(GROUP_CHARS, ENTRY_CHARS * entries)
        del data, vocab, merges, made, grown, single, names, age, none  # the tables below reuse their memory
        self._tables(entries)

    def _tables(self, entries: int) -> None:
        """What the words of a batch need: the automaton's trie, tokens by length, merges, checked pairs."""
        code = {s: i for i, s in enumerate(self.symbols)}
        code |= {chr(ord(s) + LAST): 256 + i for s, i in code.items()}
        tokens = [(key, token) for key, token in self.automaton.items() if code.keys() >= set(key)]  # no word has other symbols
        symbols = np.fromiter((code[c] for key, _ in tokens for c in key), np.int64)
        sizes, of = np.array([len(key) for key, _ in tokens], np.int64), np.array([token for _, token in tokens], np.int64)
        first, node = np.cumsum(sizes) - sizes, np.zeros(len(tokens), np.int64)
        self.size, self.shorter = np.zeros(self.count + 1, np.int64), np.full(self.count + 1, -1, np.int64)
        self.size[of] = sizes
        edges, longest = [np.zeros(0, np.int64)], np.array([-1])
        for depth in range(sizes.max(initial=0)):  # the nodes of a depth follow those above them
            some = np.flatnonzero(sizes > depth)
            edge, place = np.unique(node[some] * 512 + symbols[first[some] + depth], return_inverse=True)
            node[some] = len(longest) + place
            edges.append(edge)
            longest = np.concatenate([longest, longest[edge >> 9]])
            ends = np.flatnonzero(sizes == depth + 1)
            self.shorter[of[ends]] = longest[node[ends]]
            longest[node[ends]] = of[ends]
        edges = np.concatenate(edges)
        self.edges, self.longest = Table(edges, np.arange(1, len(edges) + 1)), longest
        pairs = np.fromiter(self.pairs, np.int64, len(self.pairs))
        self.merged = Table(pairs, np.fromiter(self.pairs.values(), np.int64, len(self.pairs)))
        self.lefts, self.rights = np.array(self.left, np.int64), np.array(self.right, np.int64)
        self.id_of = np.array(self.ids, "<u4")
        # A pair and, in the lowest bit, whether it is compatible; a later pair takes the place of an earlier one.
        self.checked_bits = int(2 * entries).bit_length()
        self.checked = np.full(1 << self.checked_bits, -1, np.int64)

    def _grows(self, t: int) -> bool:
        return self._fits(self.left[t], self.right[t], t)

    def _fits(self, a: int, b: int, bound: int) -> bool:
        """Undo merges from the youngest on; no pair at the border may be older than ``bound``."""
        pairs, left, right, n, single = self.pairs, self.left, self.right, self.count, self.single
        while True:
            merged = pairs.get(a * n + b)
            if merged is not None and merged < bound:
                return False
            if a > b:
                if a < single:
                    return True
                bound, a = a, right[a]
            else:
                if b < single:
                    return True
                bound, b = b + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        if a < 0:  # an unknown symbol before
            return False
        key = a * self.count + b
        got = self.known.get(key)
        if got is None:
            self.known.put(key, got := self._fits(a, b, self.count))
        return got

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one word, given as symbols of which the last is in the plane of last ones."""
        last = [-1] * (len(word) + 1)
        start = [0] * (len(word) + 1)
        known, count, length, done = self.known.young.get, self.count, self.length, -1
        for at, token in self.automaton.iter(word):
            if at == done:  # this prefix has its last token
                continue
            before = at + 1 - length[token]
            if before:
                got = known(last[before] * count + token)
                if got is None:
                    got = self.compatible(last[before], token)
                if not got:
                    continue
            last[at + 1], start[at + 1], done = token, before, at
        out, at = [], len(word)
        while at > 0:
            if last[at] < 0:
                raise ValueError("a symbol is not in the vocabulary")
            out.append(self.ids[last[at]])
            at = start[at]
        return out[::-1]

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` for arrays of tokens."""
        keys = a * self.count + b
        at = slots(keys, self.checked_bits)
        found = self.checked[at]
        out = (found & 1).astype(bool)
        new = np.flatnonzero(found >> 1 != keys)
        if len(new):
            out[new] = self._all_fit(a[new], b[new])
            self.checked[at[new]] = keys[new] * 2 + out[new]
        return out

    def _all_fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_fits`` for arrays of tokens, without a bound."""
        out, todo = np.ones(len(a), bool), np.arange(len(a))
        bound = np.full(len(a), self.count)
        while len(todo):
            merged = self.merged.get(a * self.count + b)
            wrong = (merged >= 0) & (merged < bound)
            out[todo[wrong]] = False
            first = a > b
            young = np.where(first, a, b)
            bound = np.where(first, a, b + 1)
            more = ~wrong & (young >= self.single)
            todo, first, bound, a, b = todo[more], first[more], bound[more], a[more], b[more]
            a, b = np.where(first, self.rights[a], a), np.where(first, b, self.lefts[b])
        return out

    def _longest_from(self, codes: np.ndarray) -> np.ndarray:
        """The longest token that starts at each symbol; none crosses the last symbol of a word."""
        at = np.arange(len(codes))
        node = self.edges.get(codes)
        out = np.full(len(codes) + 1, -1, np.int64)
        depth = 1
        while True:
            there = node >= 0
            at, node = at[there], node[there].astype(np.int64)
            out[at] = self.longest[node]
            inside = at + depth < len(codes)
            at, node = at[inside], node[inside]
            if not len(at):
                return out
            node = self.edges.get(node * 512 + codes[at + depth])
            depth += 1

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of many different words of up to LONG bytes."""
        raw = [w.encode() for w in words]
        codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        stops = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        starts = np.concatenate([[0], stops[:-1]])
        codes[stops - 1] += 256
        longest = self._longest_from(codes)
        # By border between symbols. The start of a word is the end of the one before, but is never entered.
        last, dead = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, bool)
        word, at, start, stop = np.arange(len(raw)), starts, starts, stops
        before, token = np.full(len(raw), -1, np.int64), longest[starts]
        while len(word) >= FEW:
            has = token >= 0
            end = at + self.size[token]
            good = has & ~dead[end]
            pair = np.flatnonzero(good & (before >= 0))
            good[pair] = self.all_compatible(before[pair], token[pair])
            none = np.flatnonzero(~has)
            if (at[none] == start[none]).any():
                raise ValueError("a symbol is not in the vocabulary")
            dead[at[none]] = True
            last[end[good]] = token[good]
            undone = last[at[none]]
            # On to the longest token behind, or to the next shorter one here, or back.
            following = np.where(good, longest[end * good], self.shorter[token])
            before, at = np.where(good, token, before), np.where(good, end, at)
            at[none] -= self.size[undone]
            before[none] = np.where(at[none] > start[none], last[at[none]], -1)
            following[none] = self.shorter[undone]
            more = at < stop
            word, at, start, stop, before, token = word[more], at[more], start[more], stop[more], before[more], following[more]
        done = np.ones(len(raw), bool)
        done[word] = False
        used = np.zeros(len(codes) + 1, bool)
        at, start = stops[done], starts[done]
        while len(at):
            used[at] = True
            at = at - self.size[last[at]]
            more = at > start
            at, start = at[more], start[more]
        ids = self.id_of[last[np.flatnonzero(used)]].tobytes()
        bounds = (4 * np.cumsum(used))[stops].tolist()
        out = [ids[low:high] for low, high in zip([0, *bounds], bounds)]
        for k in word.tolist():
            out[k] = self._word(words[k])
        return out

    def _word(self, word: str) -> bytes:
        # The symbol of a printable ASCII character is the character.
        symbols = word if word.isascii() and word.isalpha() else "".join(map(self.symbols.__getitem__, word.encode()))
        ids = self.encode_symbols(symbols[:-1] + chr(ord(symbols[-1]) + LAST))
        return array("I", ids).tobytes()

    def _split(self, chunk: str) -> list[str]:
        """The words of a chunk that has more than letters."""
        letters = chunk.rstrip(PUNCTUATION)  # no word starts or ends within such a run
        return [letters, chunk[len(letters) :]] if letters.isalpha() else self.words.findall(chunk)

    def _chunks(self, text: str) -> list[str]:
        """Chunks between white space, which no word crosses."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        # Letters fall to lower case one by one, so a last sigma is not a special case.
        text = text.lower()
        return self.spaces.split(text) if self.odd.search(text) else text.split()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the younger generation does not have."""
        young, old = self.of_chunk.young, self.of_chunk.old
        out, cut, fresh = {}, {}, []
        for chunk in chunks:
            got = old.get(chunk)
            if got is not None:
                out[chunk] = got
            elif chunk.isalpha():
                fresh.append(chunk)
            else:
                cut[chunk] = self._split(chunk)
        for word in {w for parts in cut.values() for w in parts}.difference(fresh):
            got = out.get(word) or young.get(word) or old.get(word)
            if got is None:
                fresh.append(word)
            else:
                out[word] = got
        short = [w for w in fresh if 4 * len(w) <= LONG or len(w.encode()) <= LONG]
        if len(short) >= FEW:
            out.update(zip(short, self.encode_words(short)))
        for word in fresh:
            if word not in out:
                out[word] = self._word(word)
        for chunk, parts in cut.items():
            out[chunk] = b"".join([out[w] for w in parts])
        self.of_chunk.put_all({c: ids for c, ids in out.items() if len(c) <= CACHE_CHARS})
        return out

    def _join(self, lists: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of chunks; each different chunk is looked up once."""
        chunks = set().union(*lists)
        ids = dict(zip(chunks, map(self.of_chunk.young.get, chunks)))
        missing = [c for c, got in ids.items() if got is None]
        if missing:
            ids.update(self._learn(missing))
        return [b"".join(map(ids.__getitem__, some)) for some in lists]

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        """Special tokens stay whole; what is between them is split on its own."""
        parts = [self.split_special.split(t) if self.split_special is not None and "<" in t else [t] for t in texts]
        plain = iter(self._join([self._chunks(p) for split in parts for p in split[::2]]))
        return [b"".join([self.specials[p].to_bytes(4, "little") if i % 2 else next(plain) for i, p in enumerate(split)]) for split in parts]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, group, chars = [], [], 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars >= self.group_chars:
                out += self._encode_group(group)
                group, chars = [], 0
        return out + self._encode_group(group)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes | None) -> str:
        if not ids:
            return ""
        got = array("I")
        got.frombytes(ids)
        return " ".join(map(self.names.__getitem__, got))


@functools.lru_cache(maxsize=2)
def _loaded(spec: str, entries: int = CACHE_ENTRIES) -> Bpe:
    bpe = Bpe(spec, entries)
    gc.freeze()  # the tables stay; the collector need not visit them
    return bpe


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _shared(df: DataFrame, path: str | None):
    """The vocabulary file travels as a broadcast (a few MB), so executors need no copy of it."""
    with open(path or default_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Add the packed ids of each whole text: little-endian unsigned 32-bit integers.

    ``entries`` bounds each cache of a worker; fewer take less memory and more time, ids are the same.
    """
    spec = _shared(df, path)

    @F.pandas_udf(T.BinaryType())
    def run(texts: pd.Series) -> pd.Series:
        bpe = _loaded(spec.value, entries)
        return pd.Series(bpe.encode_all(texts), dtype=object)

    return with_columns(df, **{ids: run(F.col(text))})


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add the text of packed ids."""
    spec = _shared(df, path)

    @F.pandas_udf(T.StringType())
    def run(packed: pd.Series) -> pd.Series:
        bpe = _loaded(spec.value)
        return pd.Series([bpe.decode(p) for p in packed], dtype=object)

    return with_columns(df, **{text: run(F.col(ids))})
