"""Queueing-model capacity questions over a table of services.

``services`` holds one row per (topology, cid) with ``lam`` and ``mu`` per
second and ``k`` servers. All questions are answered for all topologies at once.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cmv
from ..functions import queueing as Q
from ..scale import RowNumber, RunningSum, range_scan
from ..session import materialize

# Servers a service offers in the first round of an allocation.
FIRST_OFFER = 4


def _lm() -> tuple[Column, Column]:
    return F.col("lam"), F.col("mu")


def service_load(rollup: DataFrame, tasks: DataFrame, interval_s: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Load of each component from its rolled-up telemetry (long form).

    ``tasks(component, n_tasks)``. A service without processed rows has mean
    time 0 and an unbounded service rate.
    """

    def total(metric: str, col: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == metric, F.col(col))), F.lit(0))

    pairs = {"proc": "process", "arr": "recv-queue-arrivals", "sq": "send-queue-length", "rq": "recv-queue-length"}
    sums = [total(m, c).alias(f"{p}_{c}") for p, m in pairs.items() for c in ("cnt", "total")]
    wide = rollup.groupBy(*keep, "component", "type").agg(*sums)
    wide = wide.join(tasks, "component", "left").fillna(0, ["n_tasks"])
    rate = cmv.avg("arr_cnt", "arr_total") / interval_s
    mean = cmv.avg("proc_cnt", "proc_total")
    ratio = F.when(F.col("proc_cnt") == 0, F.lit(0.0)).otherwise((F.col("arr_total") - F.col("arr_cnt")) / F.col("proc_cnt"))
    return wide.select(
        *keep, "component", "type", F.col("n_tasks").cast("bigint").alias("n_tasks"),
        rate.alias("arrival_rate"), (rate * F.col("n_tasks")).alias("lam"),
        F.when(mean == 0, F.lit(float("inf"))).otherwise(1000.0 / F.nullif(mean, F.lit(0.0))).alias("mu"),
        (rate * mean / 1000.0).alias("rho"), ratio.alias("input_ratio"), mean.alias("avg_ms"),
        cmv.avg("sq_cnt", "sq_total").alias("send_len"), cmv.avg("rq_cnt", "rq_total").alias("recv_len"),
    )


def load_flags(load: DataFrame, qos_ms: float = 5000.0, send_limit: float = 5.0, recv_ratio: float = 0.6, recv_size: int = 1024) -> DataFrame:
    """Threshold flags on ``service_load`` rows; the latency flag concerns sources only."""
    return load.withColumn("send_ok", F.col("send_len") < send_limit).withColumn(
        "recv_ok", F.col("recv_len") < recv_ratio * recv_size
    ).withColumn("qos_ok", F.when(F.col("type") == "spout", F.col("avg_ms") < qos_ms))


def service_keys(services: DataFrame) -> DataFrame:
    """Adds utilisation, stability and fewest servers."""
    lam, mu = _lm()
    k = F.col("k")
    return services.withColumn("rho", Q.rho(lam, mu, k)).withColumn("stable", Q.stable(lam, mu, k)).withColumn(
        "min_k", Q.min_servers(lam, mu)
    )


def chain_latency(services: DataFrame, allocation: DataFrame | None = None) -> DataFrame:
    """(topology, latency_s, latency_ms, stable): summed M/M/k times of a chain.

    Every service needs an allocation(topology, cid, k); a missing one is an error.
    """
    lam, mu = _lm()
    rows = services
    if allocation is not None:
        given = allocation.select("topology", "cid", F.col("k").alias("__k"))
        rows = services.drop("k").join(given, ["topology", "cid"], "left")
        missing = F.concat(F.lit("no allocation for "), "topology", F.lit("/"), "cid")
        rows = rows.withColumn("k", F.coalesce("__k", F.raise_error(missing).cast("bigint"))).drop("__k")
    timed = rows.withColumn("t", Q.erlang_sojourn(lam, mu, F.col("k")))
    ok = F.bool_and(F.col("t") < Q.UNBOUNDED)
    sums = timed.groupBy("topology").agg(F.sum(F.when(F.col("t") < Q.UNBOUNDED, F.col("t"))).alias("s"), ok.alias("stable"))
    unbounded = F.lit(Q.UNBOUNDED)
    return sums.select(
        "topology", F.when(F.col("stable"), F.col("s")).otherwise(unbounded).alias("latency_s"),
        F.when(F.col("stable"), F.col("s") * 1000.0).otherwise(unbounded).alias("latency_ms"), "stable",
    )


def chain_stable(services: DataFrame) -> DataFrame:
    lam, mu = _lm()
    return services.groupBy("topology").agg(F.bool_and(Q.stable(lam, mu, F.col("k"))).alias("stable"))


def server_totals(services: DataFrame) -> DataFrame:
    """(topology, min_total, plan_total); an undefined service makes the minimum unbounded."""
    lam, mu = _lm()
    need = services.withColumn("min_k", Q.min_servers(lam, mu))
    sums = need.groupBy("topology").agg(
        F.sum("min_k").alias("s"), F.max(F.col("min_k") == Q.INT_MAX).alias("undefined"), F.sum("k").cast("bigint").alias("plan_total")
    )
    return sums.select("topology", F.when(F.col("undefined"), Q.INT_MAX).otherwise(F.col("s")).cast("bigint").alias("min_total"), "plan_total")


def _greedy(services: DataFrame, taken: Column, cap: str | None = None) -> DataFrame:
    """``services`` with ``won``: the servers each gets when the best latency drops are taken first.

    Sojourn time is convex in k, so taking the largest drops in order equals adding
    one server at a time to the best service. ``taken`` accepts a drop by its ``rank``
    or ``gained`` (drops up to it, its own ``gain`` included). A service offers a few
    servers at first; where all of its offers were taken, it offers twice as many (``cap``
    names a column with the most that can be needed) and its topology is ranked again, so
    the work follows the servers that are added.
    """
    lam, mu = _lm()
    first = F.lit(FIRST_OFFER).cast("bigint")
    waiting = materialize(services.withColumn("offer", F.least(first, cap) if cap else first))
    names, done = services.columns, []
    while True:
        times = waiting.withColumn("__times", Q.erlang_sojourns(lam, mu, F.col("min_k"), F.col("offer")))
        drops = F.zip_with(F.slice("__times", 1, F.col("offer").cast("int")), F.slice("__times", 2, F.col("offer").cast("int")), lambda a, b: a - b)
        steps = times.select(*names, F.posexplode(drops).alias("step", "gain")).withColumn("order", -F.col("gain"))
        ranked = range_scan(steps, ["topology"], ["order", "cid", "step"], [RowNumber("rank"), RunningSum("gained", "gain")])
        won = ranked.where(taken).groupBy("topology", "cid").agg(F.count(F.lit(1)).alias("won"))
        rows = waiting.join(won, ["topology", "cid"], "left").withColumn("won", F.coalesce("won", F.lit(0)))
        full = F.col("won") >= F.col("offer")
        rows = rows.withColumn("full", full & (F.col("offer") < F.col(cap)) if cap else full)
        again = rows.groupBy("topology").agg(F.bool_or("full").alias("again"))
        rows = materialize(rows.join(again, "topology"))
        done.append(rows.where(~F.col("again")).select(*names, "won"))
        if rows.where("again").isEmpty():
            return functools.reduce(DataFrame.union, done)
        more = F.col("offer") * 2
        more = F.when(F.col("full"), F.least(more, cap) if cap else more).otherwise(F.col("offer"))
        waiting = rows.where("again").select(*names, more.alias("offer"))


def suggest_allocation(services: DataFrame, budgets: DataFrame) -> DataFrame:
    """(topology, cid, k) for budgets(topology, total); k is null when the minimum does not fit."""
    lam, mu = _lm()
    totals = server_totals(services).select("topology", "min_total")
    base = services.select("topology", "cid", "lam", "mu").withColumn("min_k", Q.min_servers(lam, mu))
    base = base.join(totals.join(budgets.select("topology", "total"), "topology"), "topology")
    base = base.withColumn("fits", (F.col("min_total") < Q.INT_MAX) & (F.col("min_total") <= F.col("total")))
    base = materialize(base.withColumn("spare", F.when(F.col("fits"), F.col("total") - F.col("min_total")).otherwise(0).cast("bigint")))
    won = _greedy(base.where("spare > 0"), F.col("rank") <= F.col("spare"), "spare").select("topology", "cid", "won")
    out = base.join(won, ["topology", "cid"], "left")
    k = F.when(F.col("fits"), F.col("min_k") + F.coalesce("won", F.lit(0)))
    return out.select("topology", "cid", k.cast("bigint").alias("k"))


def min_allocation_for_target(services: DataFrame, targets: DataFrame) -> DataFrame:
    """Fewest servers that meet targets(topology, target_s, adj[, delta]).

    (topology, cid, k); k is null when the target cannot be met. A server that
    changes nothing in double precision is never added.
    """
    lam, mu = _lm()
    delta = F.col("delta") if "delta" in targets.columns else F.lit(0.0)
    goals = targets.select("topology", F.col("target_s").cast("double").alias("target_s"), F.col("adj").cast("double").alias("adj"), delta.cast("double").alias("delta"))
    rows = services.select("topology", "cid", "lam", "mu").withColumn("min_k", Q.min_servers(lam, mu)).join(goals, "topology")
    per = rows.groupBy("topology").agg(
        F.sum(1.0 / F.nullif(mu, F.lit(0.0))).alias("floor_s"), F.min("mu").alias("low_mu"),
        F.sum(Q.erlang_sojourn(lam, mu, F.when(mu > 0, F.col("min_k")).otherwise(1))).alias("base_s"),
    )
    rows = rows.join(per, "topology")
    scaled_ok = F.col("floor_s") * F.col("adj") < F.col("target_s")
    plain_ok = F.col("floor_s") + F.col("delta") <= F.col("target_s")
    rows = materialize(rows.withColumn("feasible", (F.col("low_mu") > 0) & plain_ok & scaled_ok))
    # A server is added while the target is missed without it.
    before = (F.col("base_s") - (F.col("gained") - F.col("gain"))) * F.col("adj")
    won = _greedy(rows.where("feasible"), (before > F.col("target_s")) & (F.col("gain") > 0)).select("topology", "cid", "won")
    out = rows.join(won, ["topology", "cid"], "left")
    return out.select("topology", "cid", F.when(F.col("feasible"), F.col("min_k") + F.coalesce("won", F.lit(0))).cast("bigint").alias("k"))


def capacity_report(services: DataFrame, goals: DataFrame) -> DataFrame:
    """One row per topology for goals(topology, qos_ms, real_ms); a null real_ms means the estimate.

    ``action`` is ``add`` (``extra`` servers), ``rebalance`` or ``unreachable``.
    """
    estimated = chain_latency(services).select("topology", F.col("latency_ms").alias("est_ms"))
    rows = estimated.join(goals, "topology").join(server_totals(services), "topology")
    rows = rows.withColumn("real_ms", F.coalesce("real_ms", "est_ms"))
    rows = materialize(rows.withColumn("ratio", F.greatest(F.lit(1.0), F.col("real_ms") / F.col("est_ms"))))
    targets = rows.select("topology", (F.col("qos_ms") / 1000.0).alias("target_s"), F.col("ratio").alias("adj"))
    plan = materialize(min_allocation_for_target(services, targets))
    reachable = plan.groupBy("topology").agg(F.bool_and(F.col("k").isNotNull()).alias("reachable"), F.sum("k").alias("min_plan_total"))
    known = services.join(reachable.where("reachable").select("topology"), "topology", "left_semi")
    reached = chain_latency(known, plan).select("topology", F.col("latency_ms").alias("min_plan_ms"))
    rows = rows.join(reachable, "topology").join(reached, "topology", "left")
    extra = F.col("min_plan_total") - F.col("plan_total")
    action = F.when(~F.col("reachable"), "unreachable").when(extra > 0, "add").otherwise("rebalance")
    return rows.select(
        "topology", "est_ms", "real_ms", "ratio", (F.col("est_ms") < F.col("qos_ms")).alias("est_ok"),
        (F.col("real_ms") < F.col("qos_ms")).alias("real_ok"), "plan_total", "min_plan_total", "min_plan_ms",
        (F.col("min_plan_ms") * F.col("ratio")).alias("adj_min_plan_ms"),
        F.when(F.col("reachable") & (extra > 0), extra).alias("extra"), action.alias("action"),
    )


def rebalance_plan(services: DataFrame, report: DataFrame) -> DataFrame:
    """(topology, cid, k, suggested_k): current and best use of the current servers."""
    chosen = report.where("action = 'rebalance'").select("topology", F.col("plan_total").alias("total"))
    best = suggest_allocation(services.join(chosen.select("topology"), "topology", "left_semi"), chosen)
    return services.select("topology", "cid", "k").join(best.withColumnRenamed("k", "suggested_k"), ["topology", "cid"])
