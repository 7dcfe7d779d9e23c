"""Capacity, partition-plan and transition queries."""

from pyspark.sql import functions as F

from ..functions import queueing as Q
from ..operators import capacity as C
from ..operators import partitions as N
from ..operators import transitions as S
from ..session import materialize
from ..sources import records as R
from . import inputs as I
from .registry import query
from .sql import UNBOUNDED, erlang, with_

def rates():
    return F.col("lam"), F.col("mu"), F.col("k")



def r6(c):
    """Rounded, the unbounded marker kept."""
    return F.when(F.col(c) < Q.UNBOUNDED, F.round(c, 6)).otherwise(F.col(c)).alias(c)


def q6(c):
    return f"CASE WHEN {c} < {UNBOUNDED} THEN round({c}, 6) ELSE {c} END AS {c}"


@query("svc_rho", with_("SELECT topology, cid, round(lam / (mu * k), 6) AS rho, lam < mu * k AS stable, min_k FROM svck", "svck"))
def svc_rho(spark, sf):
    return C.service_keys(I.services(spark, sf)).select("topology", "cid", F.round("rho", 6).alias("rho"), "stable", "min_k")


@query("svc_erlang", with_(f"SELECT topology, cid, {q6('t')} FROM (SELECT topology, cid, {erlang('k')} AS t FROM svck)", "svck"))
def svc_erlang(spark, sf):
    return I.services(spark, sf).withColumn("t", Q.erlang_sojourn(*rates())).select("topology", "cid", r6("t"))


@query("svc_mm1", with_(f"SELECT topology, cid, {q6('t')} FROM (SELECT topology, cid, CASE WHEN lam < mu * k THEN 1 / (mu * k - lam) ELSE {UNBOUNDED} END AS t FROM svck)", "svck"))
def svc_mm1(spark, sf):
    return I.services(spark, sf).withColumn("t", Q.pooled_mm1_sojourn(*rates())).select("topology", "cid", r6("t"))


@query("svc_type", with_("""SELECT topology, cid, CASE kind WHEN 'Exponential' THEN 'Exp' WHEN 'Deterministic' THEN 'Det' WHEN 'Uniform' THEN 'Uni' ELSE 'Other' END AS label FROM svc""", "svc"))
def svc_type(spark, sf):
    return I.services(spark, sf).select("topology", "cid", Q.service_label(F.col("kind")).alias("label"))


@query("chain_latency", with_(f"""SELECT topology, {q6('latency_s')}, {q6('latency_ms')}, stable FROM (SELECT topology, CASE WHEN stable THEN s ELSE {UNBOUNDED} END AS latency_s,
  CASE WHEN stable THEN s * 1000 ELSE {UNBOUNDED} END AS latency_ms, stable FROM chain)""", "chain"))
def chain_latency(spark, sf):
    s = I.services(spark, sf)
    out = C.chain_latency(s, s.select("topology", "cid", "k"))
    return out.select("topology", r6("latency_s"), r6("latency_ms"), "stable")


@query("chain_stable", with_("SELECT topology, bool_and(lam < mu * k) AS stable FROM svck GROUP BY 1", "svck"))
def chain_stable(spark, sf):
    return C.chain_stable(I.services(spark, sf))


@query("min_servers_total", with_("SELECT topology, min_total, plan_total FROM totals", "totals"))
def min_servers_total(spark, sf):
    return C.server_totals(I.services(spark, sf))


SUGGEST = f"""SELECT s.topology, s.cid, CASE WHEN min_total <= plan_total THEN min_k + coalesce(won, 0) END AS k FROM svck s JOIN totals USING (topology) LEFT JOIN (
  SELECT topology, cid, count(*) AS won FROM (SELECT topology, cid, plan_total - min_total AS spare, row_number() OVER (PARTITION BY topology ORDER BY gain DESC, cid, step) AS rk FROM (
    SELECT *, {erlang('(min_k + step - 1)')} - {erlang('(min_k + step)')} AS gain FROM svck JOIN totals USING (topology), LATERAL (SELECT unnest(generate_series(1, plan_total - min_total)) AS step)))
  WHERE rk <= spare GROUP BY ALL) w USING (topology, cid)"""


@query("suggest_allocation", with_(SUGGEST, "svck", "totals"))
def suggest_allocation(spark, sf):
    s = materialize(I.services(spark, sf))
    return C.suggest_allocation(s, C.server_totals(s).select("topology", F.col("plan_total").alias("total")))


@query("min_alloc_for_target", with_("SELECT topology, cid, k FROM plan_a", "plan_a"))
def min_alloc_for_target(spark, sf):
    s = materialize(I.services(spark, sf))
    per = s.groupBy("topology").agg(F.sum(1.0 / F.col("mu")).alias("f"))
    factor = F.when(F.col("topology") == "t8", 0.5).otherwise(1.3)
    targets = per.select("topology", (F.col("f") * factor).alias("target_s"), F.lit(1.1).alias("adj"))
    return C.min_allocation_for_target(s, targets)


@query("capacity_report", with_(f"""SELECT topology, {q6('est_ms')}, round(real_ms, 6) AS real_ms, round(ratio, 6) AS ratio, est_ms < qos_ms AS est_ok, real_ms < qos_ms AS real_ok,
    plan_total, CAST(need AS BIGINT) AS min_plan_total, CASE WHEN NOT reachable THEN NULL WHEN need > plan_total THEN CAST(need - plan_total AS BIGINT) END AS extra,
    CASE WHEN NOT reachable THEN 'unreachable' WHEN need > plan_total THEN 'add' ELSE 'rebalance' END AS action FROM (
  SELECT topology, CASE WHEN stable THEN s * 1000 ELSE {UNBOUNDED} END AS est_ms, real_ms, qos_ms, adj AS ratio, plan_total, need, reachable
  FROM chain JOIN goals USING (topology) JOIN target_r USING (topology) JOIN totals USING (topology)
  JOIN (SELECT topology, sum(k) AS need, bool_and(k IS NOT NULL) AS reachable FROM plan_r GROUP BY 1) USING (topology))""", "chain", "goals", "target_r", "totals", "plan_r"))
def capacity_report(spark, sf):
    s = materialize(I.services(spark, sf))
    rep = C.capacity_report(s, I.goals(s).select("topology", "qos_ms", "real_ms"))
    return rep.select("topology", r6("est_ms"), F.round("real_ms", 6).alias("real_ms"), F.round("ratio", 6).alias("ratio"), "est_ok", "real_ok", "plan_total", "min_plan_total", "extra", "action")


@query("rebalance_plan", with_(f"""SELECT s.topology, s.cid, s.k, g.k AS suggested_k FROM svck s JOIN ({SUGGEST}) g ON g.topology = s.topology AND g.cid = s.cid
  JOIN (SELECT topology FROM (SELECT topology, sum(k) AS need, bool_and(k IS NOT NULL) AS reachable FROM plan_r GROUP BY 1) JOIN totals USING (topology)
    WHERE reachable AND need <= plan_total) r ON r.topology = s.topology""", "svck", "totals", "plan_r"))
def rebalance_plan(spark, sf):
    s = materialize(I.services(spark, sf))
    rep = materialize(C.capacity_report(s, I.goals(s).select("topology", "qos_ms", "real_ms")))
    return C.rebalance_plan(s, rep)


# --- transitions ------------------------------------------------------------


def frequencies(spark, sf):
    return S.transition_freq(I.states(spark, sf))


@query("transition_freq", with_("SELECT from_state, to_state, cnt, round(p, 6) AS p FROM trans", "trans"))
def transition_freq(spark, sf):
    return frequencies(spark, sf).select("from_state", "to_state", "cnt", F.round("p", 6).alias("p"))


@query("parse_transitions", with_("SELECT from_state, to_state, round(p, 6) AS p FROM trans", "trans"))
def parse_transitions(spark, sf):
    lines = frequencies(spark, sf).select(F.concat_ws(":", "from_state", "to_state", F.format_string("%.6f", "p")).alias("text"))
    return R.parse_transitions(lines)


@query("transition_prob", with_("SELECT from_state, to_state, round(p / sum(p) OVER (PARTITION BY from_state) + 3e-9, 6) AS prob FROM trans", "trans"))
def transition_prob(spark, sf):
    return S.transition_prob(materialize(frequencies(spark, sf))).select("from_state", "to_state", F.round(F.col("prob") + 3e-9, 6).alias("prob"))


@query("neighbor_prob", with_("""SELECT state, neighbor, round(p / sum(p) OVER (PARTITION BY state) + 3e-9, 6) AS prob FROM (SELECT state, neighbor, sum(p) AS p FROM (
  SELECT from_state AS state, to_state AS neighbor, p FROM trans UNION ALL SELECT to_state, from_state, p FROM trans WHERE from_state <> to_state) GROUP BY ALL)""", "trans"))
def neighbor_prob(spark, sf):
    return S.neighbor_prob(materialize(frequencies(spark, sf))).select("state", "neighbor", F.round(F.col("prob") + 3e-9, 6).alias("prob"))


@query("distinct_states", with_("SELECT from_state AS state FROM trans UNION SELECT to_state FROM trans", "trans"))
def distinct_states(spark, sf):
    return S.distinct_states(frequencies(spark, sf))


# --- partition plans --------------------------------------------------------


def ranges(items):
    return N.sizes_to_ranges(I.plans(items))


def plan_pairs(plans):
    ids = plans.select("plan_id").distinct()
    pairs = ids.select(F.col("plan_id").alias("plan_a"), F.explode(F.array(*[F.lit(g) for g in (4, 6, 8)])).alias("plan_b"))
    return pairs.where("plan_a <> plan_b")


def overlaps(items):
    return N.plan_overlap(items, ranges(items), plan_pairs(I.plans(items)))


@query("plan_ranges", with_("SELECT grp, plan_id, CAST(bucket AS INTEGER) AS bucket, lo AS start_idx, hi AS end_idx, hi - lo + 1 AS size FROM ranges", "ranges"))
def plan_ranges(spark, sf):
    r = ranges(I.items(spark, sf))
    back = N.ranges_to_sizes(r)
    both = r.join(back, ["grp", "plan_id", "bucket"])
    return both.select("grp", "plan_id", "bucket", F.col("start").alias("start_idx"), F.col("end").alias("end_idx"), "size")


@query("load_cap", with_("""SELECT grp, idx, round(limit_w, 4) AS limit_w, round(least(w, limit_w), 4) AS capped FROM (
  SELECT grp, idx, w, sum(w) OVER (PARTITION BY grp) / 20 * 1.3 AS limit_w FROM items)""", "items"))
def load_cap(spark, sf):
    c = N.load_cap(I.items(spark, sf), 20)
    return c.select("grp", "idx", F.round("limit", 4).alias("limit_w"), F.round("capped", 4).alias("capped"))


@query("plan_validate", with_("""SELECT grp, plan_id, violation FROM (SELECT grp, plan_id, unnest(list_filter([
    CASE WHEN n < b THEN 'fewer items than buckets' END, CASE WHEN n <> len THEN 'plan length differs from item count' END], lambda x: x IS NOT NULL)) AS violation FROM (
  SELECT grp, plan_id, count(*) AS b, sum(size) AS len FROM (
    SELECT grp, plan_id, bucket, size + CASE WHEN plan_id = 8 AND bucket = 1 AND grp LIKE '%1' THEN 1 ELSE 0 END AS size FROM plans) GROUP BY ALL)
  JOIN (SELECT grp, count(*) AS n FROM items GROUP BY 1) USING (grp))""", "plans", "items"))
def plan_validate(spark, sf):
    """Some plans are made one item too long."""
    wrong = (F.col("plan_id") == 8) & (F.col("bucket") == 1) & F.col("grp").like("%1")
    items = I.written_items(spark, sf)
    plans = I.plans(items).withColumn("size", F.col("size") + F.when(wrong, 1).otherwise(0))
    return N.plan_validate(items, plans)


@query("plan_feasible", with_("""SELECT grp, plan_id, bool_and(load <= lim) AS feasible FROM (SELECT grp, plan_id, bucket, lim, sum(least(w, lim)) AS load FROM (
  SELECT p.*, t.total / p.plan_id * 1.05 AS lim FROM placed p JOIN (SELECT grp, sum(w) AS total FROM items GROUP BY 1) t USING (grp)) GROUP BY ALL) GROUP BY ALL""", "placed", "items"))
def plan_feasible(spark, sf):
    items = I.written_items(spark, sf)
    return N.plan_feasible(items, ranges(items), 1.05)


@query("plan_imbalance", with_("""SELECT grp, plan_id, round(sum((load - m) * (load - m)) + 3e-7, 3) AS imbalance FROM (SELECT *, avg(load) OVER (PARTITION BY grp, plan_id) AS m FROM (
  SELECT grp, plan_id, bucket, coalesce(load, 0) AS load FROM plans LEFT JOIN (SELECT grp, plan_id, bucket, sum(w) AS load FROM placed GROUP BY ALL) USING (grp, plan_id, bucket))) GROUP BY ALL""", "placed", "plans"))
def plan_imbalance(spark, sf):
    items = I.written_items(spark, sf)
    return N.plan_imbalance(items, ranges(items)).select("grp", "plan_id", F.round(F.col("imbalance") + 3e-7, 3).alias("imbalance"))


@query("plan_overlap", with_("SELECT grp, plan_a, plan_b, CAST(bucket_a AS INTEGER) AS bucket_a, CAST(bucket_b AS INTEGER) AS bucket_b, round(overlap, 2) AS overlap FROM overlap", "overlap"))
def plan_overlap(spark, sf):
    return overlaps(I.written_items(spark, sf)).withColumn("overlap", F.round("overlap", 2))


@query("plan_move_cost", with_("SELECT grp, plan_a, plan_b, round(kept, 2) AS kept, round(total - kept, 2) AS moved FROM cost", "cost"))
def plan_move_cost(spark, sf):
    items = I.written_items(spark, sf)
    c = N.plan_move_cost(items, overlaps(items))
    return c.select("grp", "plan_a", "plan_b", F.round("kept", 2).alias("kept"), F.round("moved", 2).alias("moved"))


@query("chain_move_cost", with_("""SELECT grp, count(*) AS steps, round(sum(moved), 2) AS moved, round(avg(moved) + 3e-7, 2) AS avg_moved, round(sum(moved) / any_value(total), 6) AS share FROM (
  SELECT s.grp, c.total, CASE WHEN s.plan_a = s.plan_b THEN 0 ELSE c.total - c.kept END AS moved FROM (
    SELECT grp, m, plan_b, lag(plan_b) OVER (PARTITION BY grp ORDER BY m) AS plan_a FROM (SELECT DISTINCT p_brand AS grp, year(l_shipdate) * 12 + month(l_shipdate) AS m,
      [4, 6, 8][(year(l_shipdate) * 12 + month(l_shipdate)) % 3 + 1] AS plan_b FROM lineitem JOIN part ON l_partkey = p_partkey)) s
  JOIN cost c ON c.grp = s.grp AND ((c.plan_a = s.plan_a AND c.plan_b = s.plan_b) OR (s.plan_a = s.plan_b AND c.plan_a = 4 AND c.plan_b = 6))
  WHERE s.plan_a IS NOT NULL) GROUP BY grp""", "cost"))
def chain_move_cost(spark, sf):
    items = I.written_items(spark, sf)
    costs = materialize(N.plan_move_cost(items, overlaps(items)))
    c = N.chain_move_cost(I.chain_steps(spark, sf), costs)
    return c.select("grp", "steps", F.round("moved", 2).alias("moved"), F.round(F.col("avg_moved") + 3e-7, 2).alias("avg_moved"), F.round("share", 6).alias("share"))


@query("weighted_buckets", with_("""SELECT grp, idx, greatest(1, CAST(ceil(sum(w) OVER (PARTITION BY grp ORDER BY idx) / sum(w) OVER (PARTITION BY grp) * 8) AS BIGINT)) AS bucket FROM items""", "items"))
def weighted_buckets(spark, sf):
    return N.weighted_buckets(I.items(spark, sf), 8).select("grp", "idx", "bucket")


@query("plan_expected_keep", with_("""SELECT grp, plan_b, round(sum(best * CASE plan_a WHEN 4 THEN 0.5 WHEN 6 THEN 0.3 ELSE 0.2 END), 4) AS expected FROM (
  SELECT grp, plan_a, plan_b, bucket_b, max(overlap) AS best FROM overlap GROUP BY ALL) GROUP BY grp, plan_b""", "overlap"))
def plan_expected_keep(spark, sf):
    p = F.when(F.col("plan_a") == 4, 0.5).when(F.col("plan_a") == 6, 0.3).otherwise(0.2)
    items = I.written_items(spark, sf)
    weights = I.plans(items).select(F.col("plan_id").alias("plan_a")).distinct().withColumn("p", p)
    return N.plan_expected_keep(overlaps(items), weights).select("grp", "plan_b", F.round("expected", 4).alias("expected"))
