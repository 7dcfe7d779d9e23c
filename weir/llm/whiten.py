"""Whitening of embeddings by refined eigenvectors.

Spark adds up counts, sums and products of whole numbers: every vector is centred by
the rounded mean first, so products stay small, their sums are exact and the same in
any order, and the covariance V = (n sum(d d') - D D') / n^2 of the centred vectors
is rounded once. The driver holds one matrix of dim x dim numbers a length.

Eigenvectors start in single precision and are refined by the matrix-multiplication
iteration of Ogita and Aishima (2018) in extended precision: from R = I - X'X and
S = X'VX each pair of columns with separate eigenvalues gets the correction
(S_ij + e_j R_ij) / (e_j - e_i), pairs closer than the error bound get R_ij / 2, which
only restores orthogonality. Within such a cluster the columns span the right space
but are mixed: the small problem X_J'(V - mu I)X_J is solved by itself, scaled to its
own size, and the iteration goes on with the turned columns (Ogita and Aishima, 2019).

Whole vectors: a vector takes part if it is not null, has no null or non-finite entry and
its entries times ``SCALE`` fit a long. Vectors of each length are a fit of their own;
an empty vector has no component. A component whose variance is zero (to rounding)
has a null ``whitened`` and no part in ``identity_error``. A ``deviation`` that does
not fit a long is null. Rows that repeat an id or hold a null id are rows like any
other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
ROUNDS = 60
_EXACT = 2.0**53
_LONG = 2**63 - 1


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + shift as longs, of the vectors that take part."""
    v = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(2**62)))
    kept = df.where(F.col(vector).isNotNull()).where(good)
    # The planner may compute this before it filters, so entries that fit no long are left out here too.
    whole = lambda c: F.floor(F.when(F.abs(c * scale) < float(2**62), c * scale)) + F.lit(shift)
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(v, whole).alias("x"))


def _matrix(values) -> np.ndarray:
    return np.vstack([np.asarray(v, np.int64) for v in values])


def products(d: np.ndarray) -> np.ndarray:
    """Exact d' d: in doubles while no sum can exceed 2^53, else in Python integers."""
    most = float(np.abs(d).max()) if d.size else 0.0
    if most * most * len(d) < _EXACT:
        x = d.astype(np.float64)
        return (x.T @ x).astype(np.int64)
    x = d.astype(object)
    return x.T @ x


@dataclass(frozen=True)
class Moments:
    """n, the sums S of the vectors and their covariance V (divisor n) in extended precision."""

    n: int
    sums: list[int]
    cov: np.ndarray


def sums_of(df: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Length of vectors -> (n, sums). Lengths are few; only dim numbers a length reach the driver."""
    dims = df.groupBy(F.size("x").alias("dim")).count()
    places = df.select(F.size("x").alias("dim"), F.posexplode("x").alias("at", "v"))
    rows = places.groupBy("dim", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    out = {r["dim"]: (r["count"], [0] * r["dim"]) for r in dims.collect() if r["dim"] > 0}
    for r in rows.collect():
        out[r["dim"]][1][r["at"]] = int(r["s"])
    return out


def _rounded(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def moments(df: DataFrame) -> dict[int, Moments]:
    """Two passes: sums, then products of the vectors less the rounded mean."""
    sums = sums_of(df)
    mean = {dim: np.array([_rounded(s, n) for s in total], np.int64) for dim, (n, total) in sums.items()}

    def add(parts):
        have: dict[int, np.ndarray] = {}
        for part in parts:
            x = part["x"]
            dims = x.map(len).to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                m = products(_matrix(x[dims == dim]) - mean[dim])
                old = have.get(dim)
                both = m if old is None else old + m if max(np.abs(old).max(), np.abs(m).max()) < 2**61 else old.astype(object) + m
                have[dim] = both
        for dim, m in have.items():
            at = np.flatnonzero(np.triu(np.ones((dim, dim), bool)).ravel())
            yield pd.DataFrame({"dim": dim, "at": at, "v": [str(v) for v in m.ravel()[at]]})

    rows = df.select("x").mapInPandas(add, "dim int, at int, v string")
    # At most dim (dim + 1) / 2 sums a length.
    found = rows.groupBy("dim", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = {}
    for dim, (n, total) in sums.items():
        left = [s - n * int(m) for s, m in zip(total, mean[dim])]
        cov = np.zeros((dim, dim), np.longdouble)
        for r in found:
            if r["dim"] == dim:
                i, j = divmod(r["at"], dim)
                # The numerator is exact; two roundings to extended precision follow.
                cov[i, j] = cov[j, i] = np.longdouble(str(n * int(r["v"]) - left[i] * left[j])) / np.longdouble(str(n * n))
        out[dim] = Moments(n, total, cov)
    return out


def _clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Places of eigenvalues that form runs with gaps of at most ``bound``, two or more each."""
    order = np.argsort(-values, kind="stable")
    cut = np.flatnonzero(np.abs(np.diff(values[order])) > bound) + 1
    return [own for own in np.split(order, cut) if len(own) > 1]


def eigen(v: np.ndarray, rounds: int = ROUNDS, turns: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns) of a symmetric matrix, refined in extended precision."""
    v = np.asarray(v, np.longdouble)
    dim = len(v)
    size = np.abs(v).max() if v.size else 0
    if size == 0:
        return np.zeros(dim), np.eye(dim)
    a = v / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye, eps = np.eye(dim, dtype=np.longdouble), np.finfo(np.longdouble).eps
    norm = np.abs(a).sum(1).max()
    noise = 4 * dim * eps * norm
    before = np.inf
    for _ in range(rounds):
        r, s = eye - x.T @ x, x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        bound = 2 * (np.abs(off).sum(1).max() + norm * np.abs(r).sum(1).max()) + 4 * noise
        gap = e[None, :] - e[:, None]
        # Closer pairs than this are left to the sub-solves: rounding would move them at random.
        bound = max(bound, 2**20 * noise)
        apart = np.abs(gap) > bound
        change = np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
        moved = np.abs(change).max()
        x = x + x @ change
        if moved < 1e-8 and turns:
            # The spaces are right now; each cluster is solved in its own scale.
            turns -= 1
            turned = False
            for own in _clusters(e, bound):
                part = x[:, own].T @ (a - e[own].mean() * eye) @ x[:, own]
                part = (part + part.T) / 2
                if np.abs(part - np.diag(np.diag(part))).max() > noise:
                    turn = np.linalg.eigh((part / np.abs(part).max()).astype(np.float64))[1]
                    x[:, own] = x[:, own] @ turn.astype(np.longdouble)
                    turned = True
            if turned:
                before = np.inf
                continue
        if moved <= 8 * eps or (moved >= before and moved < 1e-10):
            break
        before = moved
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    # Unit length, and values from the columns as they are now.
    x = x / np.sqrt((x * x).sum(0))
    e = ((a @ x) * x).sum(0)
    order = np.argsort(-e, kind="stable")
    return (e[order] * size).astype(np.float64), x[:, order].astype(np.float64)


@dataclass(frozen=True)
class Fit:
    """What the rows need: the mean as a whole part and a rest, sums, axes (columns over the root of the eigenvalue) and shares."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    sums: tuple[int, ...]
    axes: np.ndarray
    usable: np.ndarray
    explained: np.ndarray


def fitted(m: Moments, components: int = COMPONENTS) -> Fit:
    values, vectors = eigen(m.cov)
    k = min(components, len(values))
    trace = float(np.trace(m.cov))
    usable = values[:k] > len(values) * np.finfo(np.float64).eps * max(trace, 0.0)
    axes = np.where(usable, vectors[:, :k] / np.sqrt(np.where(usable, values[:k], 1.0)), 0.0)
    whole = [_rounded(s, m.n) for s in m.sums]
    rest = np.array([float(np.longdouble(s - m.n * w) / m.n) for s, w in zip(m.sums, whole)])
    return Fit(m.n, np.array(whole, np.int64), rest, tuple(m.sums), axes, usable, values[:k] / trace if trace > 0 else np.zeros(k))


def projected(fit: Fit, x: np.ndarray) -> np.ndarray:
    """Whitened components of vectors (rows)."""
    return ((x - fit.whole).astype(np.float64) - fit.rest) @ fit.axes


def deviations(fit: Fit, x: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)^2."""
    d = x - fit.whole
    left = [s - fit.n * int(w) for s, w in zip(fit.sums, fit.whole)]
    most = int(np.abs(d).max(initial=0)) * fit.n + max(map(abs, left), default=0)
    if most * most * max(d.shape[1], 1) <= _LONG:
        z = d * fit.n - np.array(left, np.int64)
        return (z * z).sum(1).tolist()
    exact = [sum((fit.n * int(c) - q) ** 2 for c, q in zip(row, left)) for row in d]
    return [v if v <= _LONG else None for v in exact]


def identity_errors(df: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened rows less the identity, measured over all rows."""

    def add(parts):
        have: dict[int, np.ndarray] = {}
        for part in parts:
            dims = part["x"].map(len).to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                z = projected(fits[dim], _matrix(part["x"][dims == dim]))
                z = np.hstack([np.ones((len(z), 1)), z])
                have[dim] = have.get(dim, 0) + z.T @ z
        for dim, m in have.items():
            yield pd.DataFrame({"dim": dim, "at": np.arange(m.size), "v": m.ravel()})

    sums = df.select("x").mapInPandas(add, "dim int, at int, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for dim, fit in fits.items():
        k = len(fit.explained)
        m = np.zeros((k + 1) ** 2)
        for r in sums:
            if r["dim"] == dim:
                m[r["at"]] = r["v"]
        m = m.reshape(k + 1, k + 1) / fit.n
        cov = (m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]))[np.ix_(fit.usable, fit.usable)]
        out[dim] = float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))
    return out


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of whole vectors (vec_id, x)."""
    fits = {dim: fitted(m, components) for dim, m in moments(df).items()}
    wrong = identity_errors(df, fits)
    id_type = df.schema["vec_id"].dataType.simpleString()

    def run(parts):
        for part in parts:
            dims = part["x"].map(len).to_numpy()
            for dim in np.unique(dims[dims > 0]).tolist():
                own = part[dims == dim]
                x, fit = _matrix(own["x"]), fits[dim]
                z = projected(fit, x)
                values = [[float(c) if ok else None for c, ok in zip(row, fit.usable)] for row in z]
                yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "dim": dim, "deviation": pd.array(deviations(fit, x), "Int64"), "z": values})

    rows = df.select("vec_id", "x").mapInPandas(run, f"vec_id {id_type}, dim int, deviation long, z array<double>")
    # What all rows of a length share travels in the plan: a handful of numbers a component.
    known = lambda value: F.coalesce(*[F.when(F.col("dim") == d, value(f, d)) for d, f in fits.items()], value(None, None))
    shares = known(lambda f, d: F.array(*[F.lit(float(s)) for s in f.explained]) if f else F.lit(None).cast("array<double>"))
    listed = rows.withColumn("__shares", shares).withColumn("__n", known(lambda f, d: F.lit(f.n if f else None).cast("long"))).withColumn("__error", known(lambda f, d: F.lit(wrong[d] if f else None).cast("double")))
    spread = listed.select("vec_id", "deviation", "__shares", "__n", "__error", F.posexplode("z").alias("__at", "whitened"))
    return spread.select(
        "vec_id", (F.col("__at") + 1).cast("int").alias("component"), F.col("__n").alias("n"), "deviation", "whitened",
        F.get("__shares", F.col("__at")).alias("explained"), F.col("__error").alias("identity_error"),
    )
