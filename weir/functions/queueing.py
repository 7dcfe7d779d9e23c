"""Queueing-model column functions (M/M/1 and M/M/k)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results for undefined or unstable services.
UNBOUNDED = 1.7976931348623157e308
INT_MAX = 2147483647

# Service-type labels.
SERVICE_LABELS = {"Exponential": "Exp", "Deterministic": "Det", "Uniform": "Uni"}


def rho(lam: Column, mu: Column, k: Column) -> Column:
    """Utilisation of k servers."""
    undefined = (mu == 0) | (k <= 0)
    return F.when(undefined, F.lit(UNBOUNDED)).otherwise(lam / (mu * k))


def stable(lam: Column, mu: Column, k: Column) -> Column:
    return rho(lam, mu, k) < 1.0


def min_servers(lam: Column, mu: Column) -> Column:
    """Fewest servers for stability."""
    return F.when(mu == 0, F.lit(INT_MAX)).otherwise(F.floor(lam / mu) + 1).cast("bigint")


def erlang_sojourn(lam: Column, mu: Column, k: Column) -> Column:
    """Mean time in an M/M/k system.

    The blocking probability follows the Erlang-B recursion, which stays in
    [0, 1] for any k; the waiting probability is derived from it.
    """
    load = lam / mu
    # aggregate() needs an array even for rows where the result is unused.
    steps = F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1)))
    blocking = F.aggregate(steps, F.lit(1.0), lambda b, i: load * b / (i + load * b))
    waiting = blocking / (1.0 - rho(lam, mu, k) * (1.0 - blocking))
    return F.when(
        stable(lam, mu, k),
        F.when(lam == 0, 1.0 / mu).otherwise(waiting / (mu * k - lam) + 1.0 / mu),
    ).otherwise(F.lit(UNBOUNDED))


def erlang_sojourns(lam: Column, mu: Column, k: Column, more: Column) -> Column:
    """Mean times with k, k + 1, ... k + more servers by one pass of the recursion; k must be stable, more 1 at least."""
    load = lam / mu

    def step(b: Column, i: Column) -> Column:
        return load * b / (i + load * b)

    first = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), F.lit(1.0), step)
    blocking = F.aggregate(F.sequence(k + 1, k + more), F.array(first), lambda bs, i: F.concat(bs, F.array(step(F.element_at(bs, -1), i))))

    def time(b: Column, at: Column) -> Column:
        waiting = b / (1.0 - rho(lam, mu, k + at) * (1.0 - b))
        return waiting / (mu * (k + at) - lam) + 1.0 / mu

    return F.transform(blocking, time)


def pooled_mm1_sojourn(lam: Column, mu: Column, k: Column) -> Column:
    """Mean time in one server with the pooled rate of k servers."""
    return F.when(stable(lam, mu, k), 1.0 / (mu * k - lam)).otherwise(F.lit(UNBOUNDED))


def service_label(kind: Column) -> Column:
    label = F.lit("Other")
    for name, short in SERVICE_LABELS.items():
        label = F.when(kind == name, short).otherwise(label)
    return label


def factorial(n: Column) -> Column:
    """Exact factorial; null outside 0..20, where a long cannot hold it."""
    return F.factorial(n)
