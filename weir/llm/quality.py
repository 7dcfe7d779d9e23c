"""Quality classifier: regularised quadratic discriminant over document statistics.

A text becomes a vector of statistics (lengths, shares of character classes,
repetition, compressibility), each transformed to be roughly normal. Per class
Spark adds up counts, sums and products over all labelled rows; the driver gets
those few hundred numbers, shrinks each covariance towards the pooled one and
towards its own diagonal, and keeps Cholesky factors. A score is the logistic of
the difference of the two log densities plus the log of the prior odds.

Null and empty texts have the statistics of the empty text and are scored like
any other. A class without labelled rows takes the pooled moments, so the score
is the prior; without any labelled row every score is 0.5. Null labels are left
out; repeated labels count as often as they occur.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

_CLASSES = 6
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SIGN = range(_CLASSES)
_EDGE = 0x250


def _classes() -> np.ndarray:
    out = np.full(_EDGE + 1, _LOWER, np.uint8)  # beyond the edge: letters of other alphabets, mostly
    for i in range(_EDGE):
        c = chr(i)
        out[i] = _UPPER if c.isupper() else _LOWER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _STOP if c in ".,;:?'-" else _SIGN
    return out


_CLASS = _classes()
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)")


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, flat at both ends, so that none of 30 is like none of 3,000."""
    share = part / whole if whole else 0.0
    return math.log((share + 0.005) / (1.005 - share))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text."""
    text = text or ""
    cp = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), _EDGE)
    n = len(cp)
    kinds = np.bincount(_CLASS[cp], minlength=_CLASSES)
    chars = np.bincount(cp, minlength=1)
    p = chars[chars > 0] / max(n, 1)
    words = text.split()
    nw = len(words)
    sizes = np.fromiter(map(len, words), np.float64, nw)
    lines = text.split("\n")
    ends = sum(1 for w in words if not w[-1].isalnum())
    letters = kinds[_LOWER] + kinds[_UPPER]
    raw = text.encode("utf-8", "replace")
    return [
        math.log1p(n),
        math.log1p(nw),
        math.log1p(float(sizes.mean()) if nw else 0.0),
        math.log1p(float(sizes.std()) if nw else 0.0),
        math.log1p(float(sizes.max()) if nw else 0.0),
        _logit(kinds[_UPPER], letters),
        _logit(kinds[_DIGIT], n),
        _logit(kinds[_SPACE], n),
        _logit(kinds[_STOP], n),
        _logit(kinds[_SIGN], n),
        _logit(ends, nw),
        _logit(len(set(words)), nw),
        _logit(len(set(map(str.lower, words))), nw),
        _logit(sum(map(operator.eq, words, words[1:])), nw),
        math.log1p(len(lines)),
        math.log1p(n / len(lines)),
        math.log1p(len(_SENTENCE.findall(text)) * 100 / max(nw, 1)),
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        math.log((len(zlib.compress(raw, 1)) + 1) / (len(raw) + 8)),
        _logit(sum(1 for w in words if len(w) == 1), nw),
        _logit(sum(1 for w in words if w.isupper()), nw),
    ]


WIDTH = len(statistics(""))


@dataclass(frozen=True)
class Model:
    """Moments of both classes; ``inverse`` holds the inverses of the Cholesky factors."""

    prior: float
    mean: tuple[np.ndarray, np.ndarray]
    inverse: tuple[np.ndarray, np.ndarray]
    logdet: tuple[float, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        dens = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.inverse[c].T
            dens.append(-0.5 * (z * z).sum(1) - self.logdet[c])
        return 1 / (1 + np.exp(-np.clip(dens[1] - dens[0] + self.prior, -60, 60)))


def statistics_of(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return with_columns(df, **{out: run(F.col(text))})


def moments(df: DataFrame, stats: str = "stats", label: str = "label") -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products by class; only these numbers reach the driver."""

    def add(parts):
        have = {}
        for part in parts:
            y = part[label].to_numpy()
            x = np.vstack(part[stats].to_numpy()) if len(part) else np.zeros((0, WIDTH))
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in np.unique(y):
                own = x[y == c]
                have[c] = have.get(c, 0) + own.T @ own
        for c, m in have.items():
            yield pd.DataFrame({"cls": int(c), "at": np.arange(m.size), "value": m.ravel()})

    rows = df.where(F.col(label).isin(0, 1)).select(F.col(stats).alias(stats), F.col(label).cast("int").alias(label))
    sums = rows.mapInPandas(add, "cls int, at int, value double").groupBy("cls", "at").agg(F.sum("value").alias("value")).collect()
    out = {}
    for c in (0, 1):
        own = [r for r in sums if r["cls"] == c]
        m = np.zeros((WIDTH + 1) ** 2)
        for r in own:
            m[r["at"]] = r["value"]
        m = m.reshape(WIDTH + 1, WIDTH + 1)
        out[c] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def fit(df: DataFrame, stats: str = "stats", label: str = "label", shrink: float = 0.1, diagonal: float = 0.05) -> Model:
    """``shrink``: weight of the pooled covariance; ``diagonal``: weight of the diagonal."""
    got = moments(df, stats, label)
    total = got[0][0] + got[1][0]
    if total == 0:
        eye, zero = np.eye(WIDTH), np.zeros(WIDTH)
        return Model(0.0, (zero, zero), (eye, eye), (0.0, 0.0))
    all_mean = (got[0][1] + got[1][1]) / total
    mean, spread = [], []
    for n, s, q in got.values():
        mu = s / n if n else all_mean
        mean.append(mu)
        spread.append(q - n * np.outer(mu, mu))
    pooled = (spread[0] + spread[1]) / total
    inverse, logdet = [], []
    for c, (n, _, _) in got.items():
        # The fewer rows a class has, the nearer its covariance comes to the pooled one.
        weight = shrink + (1 - shrink) * WIDTH / (WIDTH + n)
        cov = (1 - weight) * (spread[c] / n if n else pooled) + weight * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(WIDTH)
        low = np.linalg.cholesky(cov)
        inverse.append(np.linalg.inv(low))
        logdet.append(float(np.log(np.diag(low)).sum()))
    prior = math.log((got[1][0] + 1) / (got[0][0] + 1))
    return Model(prior, tuple(mean), tuple(inverse), tuple(logdet))


def score(df: DataFrame, model: Model, stats: str = "stats", out: str = "score") -> DataFrame:
    """Score rows that carry their statistics."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(x.to_numpy()).astype(np.float64)) if len(x) else [], dtype="float64")

    return with_columns(df, **{out: run(F.col(stats))})


def score_texts(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Score texts in one pass, for filters that need no statistics afterwards."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype="float64")

    return with_columns(df, **{out: run(F.col(text))})
