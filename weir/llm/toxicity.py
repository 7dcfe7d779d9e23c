"""Toxicity classifier with counterfactual regularisation.

A document is the set of its lower-case words and of their first four, five and
six letters, so that inflected insults share features. Training takes a bounded
sample of the labelled rows (``rows_per_label``), counts features per label in
Spark, keeps the ``features`` that tell the labels apart best (both bounds are
parameters, the counts themselves cover the whole sample), and fits a logistic
regression on the driver. Each training document that names a group is copied
with the group swapped for the next one of its list; the squared change of the
score is penalised with ``swap_weight``, so that a group's name alone does not
make a neutral sentence look toxic.

Null and empty texts have no features and get the score of the bias. Without
toxic or without clean labels the score is the smoothed share of toxic labels.
Null labels are left out. Repeated labels count as often as they occur.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_columns

_WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)

# Names of groups by language; a name is swapped for the next one of its list.
GROUPS = (
    ("women", "men", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs", "arabes"), ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwarze", "weiße", "araber"), ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos", "árabes"), ("inmigrantes", "refugiados", "extranjeros"),
)


def words_of(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    """Whole words as they are, prefixes with a mark."""
    out = set(words)
    for k in PREFIXES:
        out.update({w[:k] + "*" for w in words if len(w) >= k})
    return out


def swapped(words: set[str], swap: dict[str, str]) -> set[str] | None:
    """The words with each group's name replaced by the next one, or None if there is none."""
    named = words & swap.keys()
    return (words - named) | {swap[w] for w in named} if named else None


def swaps(groups=GROUPS) -> dict[str, str]:
    return {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        words, get = words_of(text), self.weights.get
        z = self.bias + math.fsum(get(w, 0.0) for w in words)
        for k in PREFIXES:
            z += math.fsum(get(p + "*", 0.0) for p in {w[:k] for w in words if len(w) >= k})
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def training_sample(df: DataFrame, label: str, rows_per_label: int, key: str) -> DataFrame:
    """At most ``rows_per_label`` rows of either label, those with the smallest hash of ``key``."""
    parts = [
        df.where(F.col(label) == value).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows_per_label)
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def fit(
    sample: DataFrame, text: str = "text", label: str = "label", *, features: int = 4000, least: int = 5,
    swap_weight: float = 5.0, ridge: float = 1.0, groups=GROUPS, steps: int = 300,
) -> Model:
    """Fit on a bounded sample with a text and a label of 0 or 1."""
    swap = swaps(groups)
    both = T.StructType([T.StructField("own", T.ArrayType(T.StringType())), T.StructField("other", T.ArrayType(T.StringType()))])

    @F.pandas_udf(both)
    def extract(texts: pd.Series) -> pd.DataFrame:
        own, other = [], []
        for t in texts:
            words = words_of(t)
            turned = swapped(words, swap)
            own.append(sorted(features_of(words)))
            other.append(sorted(features_of(turned)) if turned is not None else None)
        return pd.DataFrame({"own": own, "other": other}, columns=["own", "other"])

    rows = sample.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), extract(F.col(text)).alias("f")).select("y", "f.own", "f.other")
    # The sample is bounded; its features are used twice.
    from ..session import materialize

    rows = materialize(rows)
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    prior = math.log((n1 + 1) / (n0 + 1))
    if not n0 or not n1:
        return Model(prior)
    counts = (
        rows.select("y", F.explode("own").alias("feature")).groupBy("feature")
        .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") + F.col("b") >= least)
    )
    a, b = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    strength = F.abs(F.log(a / b)) * F.sqrt(F.greatest(F.col("a"), F.col("b")).cast("double"))
    best = counts.orderBy(strength.desc(), "feature").limit(features).select("feature")
    index = {r["feature"]: i for i, r in enumerate(best.collect())}

    def pick(parts):
        for part in parts:
            yield pd.DataFrame({
                "y": part["y"],
                "own": [[index[f] for f in fs if f in index] for fs in part["own"]],
                "other": [None if fs is None else [index[f] for f in fs if f in index] for fs in part["other"]],
            }, columns=["y", "own", "other"])

    small = rows.mapInPandas(pick, "y int, own array<int>, other array<int>").collect()
    # Collected parts come in the order of the partitions; sorted rows make the fit repeatable.
    small = sorted(small, key=lambda r: (r["y"], r["own"], r["other"] or []))
    return _train(small, list(index), prior, swap_weight, ridge, steps, n0, n1)


def _train(rows, names: list[str], prior: float, swap_weight: float, ridge: float, steps: int, n0: int, n1: int) -> Model:
    """Gradient steps with momentum on log loss + ridge + squared change under swaps."""
    y = np.array([r["y"] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r["own"]) for r in rows])
    to = np.array([i for r in rows for i in r["own"]], int)
    turned = [(i, r["other"]) for i, r in enumerate(rows) if r["other"] is not None]
    # What a swap changes: features that go (+1) and that come (-1).
    changes = [(k, f, sign) for k, (i, fs) in enumerate(turned) for own in (set(rows[i]["own"]),) for new in (set(fs),) for part, sign in ((own - new, 1.0), (new - own, -1.0)) for f in sorted(part)]
    d_at = np.array([c[0] for c in changes], int)
    d_to = np.array([c[1] for c in changes], int)
    d_sign = np.array([c[2] for c in changes])
    d_size = np.bincount(d_at, minlength=len(turned))
    size = np.maximum(np.bincount(to, minlength=len(names)), 1)
    # A step per feature in proportion to how often it occurs; both labels weigh the same.
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    w, bias, v, vb = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    per_doc = max(1.0, len(to) / max(len(y), 1))
    # Bounds of the curvature along each feature: of the loss, the ridge and the swaps.
    pull = np.bincount(d_to, d_size[d_at], len(names)) if len(d_at) else 0.0
    rate = 1.0 / (0.25 * per_doc * np.sqrt(size * size.max()) + 0.5 * ridge + 2 * swap_weight * pull)
    for _ in range(steps):
        z = bias + np.bincount(at, w[to], len(y))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(to, err[at], len(names)) + ridge * w
        if len(d_at):
            change = np.bincount(d_at, d_sign * w[d_to], len(turned))
            g += 2 * swap_weight * np.bincount(d_to, d_sign * change[d_at], len(names))
        v = 0.9 * v - rate * g
        vb = 0.9 * vb - 2.0 / len(y) * err.sum() * 0.2
        w, bias = w + v, bias + vb
    return Model(float(bias), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-6})


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of each whole text; the model's size is bounded by ``features``."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return with_columns(df, **{out: run(F.col(text))})
