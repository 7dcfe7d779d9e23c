import random

import pytest
from pyspark.sql import functions as F

from weir.functions import queueing as Q
from weir.operators import capacity as C


def sojourn(lam, mu, k):
    if mu == 0 or k <= 0 or lam >= mu * k:
        return Q.UNBOUNDED
    if lam == 0:
        return 1 / mu
    a, r = lam / mu, lam / (mu * k)
    # All terms divided by a^k / k!, so large k stay in range.
    head, term = 0.0, 1.0
    for i in range(k, 0, -1):
        term *= i / a
        head += term
    wait = 1 / (1 - r) / (head + 1 / (1 - r))
    return wait / (mu * k - lam) + 1 / mu


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_erlang_golden(spark):
    assert abs(one(spark, Q.erlang_sojourn(F.lit(3.0), F.lit(1.0), F.lit(4))) - 1.509433962264151) < 1e-12
    assert one(spark, Q.erlang_sojourn(F.lit(3.0), F.lit(1.0), F.lit(3))) == Q.UNBOUNDED
    assert one(spark, Q.erlang_sojourn(F.lit(0.0), F.lit(2.0), F.lit(3))) == 0.5
    assert abs(one(spark, Q.erlang_sojourn(F.lit(150.0), F.lit(1.0), F.lit(160))) - sojourn(150.0, 1.0, 160)) < 1e-9


def test_undefined_services(spark):
    assert one(spark, Q.rho(F.lit(1.0), F.lit(0.0), F.lit(1))) == Q.UNBOUNDED
    assert one(spark, Q.rho(F.lit(1.0), F.lit(1.0), F.lit(0))) == Q.UNBOUNDED
    assert one(spark, Q.min_servers(F.lit(1.0), F.lit(0.0))) == Q.INT_MAX
    assert one(spark, Q.min_servers(F.lit(4.0), F.lit(2.0))) == 3


def make(seed, topologies=6):
    rnd = random.Random(seed)
    rows = []
    for t in range(topologies):
        for c in range(rnd.randint(1, 4)):
            mu = rnd.uniform(0.5, 3.0)
            rows.append((f"t{t}", f"c{c}", rnd.uniform(0.2, 6.0), mu, rnd.randint(1, 6)))
    return rows


def greedy(rows, total):
    k = {c: int(lam // mu) + 1 for _, c, lam, mu, _ in rows}
    by = {c: (lam, mu) for _, c, lam, mu, _ in rows}
    if sum(k.values()) > total:
        return None
    for _ in range(total - sum(k.values())):
        best = max(sorted(by), key=lambda c: sojourn(*by[c], k[c]) - sojourn(*by[c], k[c] + 1))
        k[best] += 1
    return k


SCHEMA = "topology string, cid string, lam double, mu double, k int"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suggestion_equals_greedy(spark, seed):
    rows = make(seed)
    names = sorted({r[0] for r in rows})
    budget = {t: random.Random(seed + i).randint(2, 25) for i, t in enumerate(names)}
    got = {}
    for r in C.suggest_allocation(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(budget.items()), "topology string, total int")).collect():
        got.setdefault(r.topology, {})[r.cid] = r.k
    for t in names:
        want = greedy([r for r in rows if r[0] == t], budget[t])
        assert got[t] == (want or {c: None for c in got[t]})


@pytest.mark.parametrize("seed", [4, 5])
def test_target_needs_fewest_servers(spark, seed):
    rows = make(seed)
    names = sorted({r[0] for r in rows})
    rnd = random.Random(seed)
    floor = {t: sum(1 / r[3] for r in rows if r[0] == t) for t in names}
    targets = [(t, floor[t] * rnd.choice([0.9, 1.05, 1.2, 2.0, 50.0]), 1.02) for t in names]
    got = {}
    for r in C.min_allocation_for_target(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(targets, "topology string, target_s double, adj double")).collect():
        got.setdefault(r.topology, {})[r.cid] = r.k
    for t, target, adj in targets:
        mine = [r for r in rows if r[0] == t]
        want = None
        if floor[t] * adj < target:
            n = sum(int(r[2] // r[3]) + 1 for r in mine)
            while True:
                want = greedy(mine, n)
                if sum(sojourn(r[2], r[3], want[r[1]]) for r in mine) * adj <= target:
                    break
                n += 1
        assert got[t] == (want or {c: None for c in got[t]})


def test_missing_allocation_fails(spark):
    s = spark.createDataFrame([("t", "a", 1.0, 2.0, 1), ("t", "b", 1.0, 2.0, 1)], SCHEMA)
    with pytest.raises(Exception, match="no allocation for t/b"):
        C.chain_latency(s, s.where("cid = 'a'")).collect()


def test_report_actions(spark):
    s = spark.createDataFrame([("few", "a", 3.0, 1.0, 4), ("many", "a", 3.0, 1.0, 9), ("never", "a", 3.0, 1.0, 4)], SCHEMA)
    g = spark.createDataFrame([("few", 1100.0, None), ("many", 1600.0, None), ("never", 900.0, None)], "topology string, qos_ms double, real_ms double")
    rep = C.capacity_report(s, g)
    rows = {r.topology: r for r in rep.collect()}
    assert (rows["few"].action, rows["many"].action, rows["never"].action) == ("add", "rebalance", "unreachable")
    assert rows["few"].extra == rows["few"].min_plan_total - 4 and rows["never"].min_plan_total is None
    assert [(r.topology, r.suggested_k) for r in C.rebalance_plan(s, rep).collect()] == [("many", 9)]


def test_prefix_of_times(spark):
    got = one(spark, Q.erlang_sojourns(F.lit(30.0), F.lit(1.0), F.lit(31).cast("bigint"), F.lit(9).cast("bigint")))
    assert len(got) == 10 and all(abs(t - sojourn(30.0, 1.0, 31 + i)) < 1e-9 for i, t in enumerate(got))


def test_target_close_to_the_floor(spark):
    rows = [("t", "a", 40.0, 1.0, 41), ("t", "b", 3.0, 0.5, 7), ("u", "a", 0.0, 2.0, 1)]
    targets = [("t", 3.0 + 1e-4, 1.0), ("u", 0.5 + 1e-12, 1.0)]
    got = {(r.topology, r.cid): r.k for r in C.min_allocation_for_target(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(targets, "topology string, target_s double, adj double")).collect()}
    n = 48
    while sum(sojourn(lam, mu, k) for (lam, mu), k in zip([(40.0, 1.0), (3.0, 0.5)], greedy(rows[:2], n).values())) > 3.0 + 1e-4:
        n += 1
    assert {c: got["t", c] for c in "ab"} == greedy(rows[:2], n) and got["u", "a"] == 1
