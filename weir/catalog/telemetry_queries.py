"""Telemetry queries."""

from pyspark.sql import functions as F

from ..functions import cmv
from ..functions import text as T
from ..operators import capacity as C
from ..operators import telemetry as M
from ..operators.reducers import Quantiles, reduce_by_key
from ..sources import metric_lines as L
from . import inputs as I
from .registry import query
from .sql import DAY, GOOD, RENAME, SUMS, with_


def r4(*cols):
    # The small shift keeps exact ties away from the rounding border.
    return [F.round(F.col(c) + 3e-7, 4).alias(c) for c in cols]


def tasks(spark, sf):
    return I.cluster(spark, sf).groupBy("component").agg(F.count(F.lit(1)).alias("n_tasks"))


STATS = """round(CASE WHEN cnt = 0 THEN 0 ELSE total / cnt END + 3e-7, 4) AS avg, round(CASE WHEN cnt = 0 THEN 0 ELSE total_2 / cnt END + 3e-7, 4) AS avg2,
  round(CASE WHEN cnt = 0 THEN 0 ELSE total_2 / cnt - (total / cnt) * (total / cnt) END + 3e-7, 4) AS var,
  round(CASE WHEN cnt = 0 THEN 0 ELSE total_2 / cnt / ((total / cnt) * (total / cnt)) - 1 END + 3e-7, 4) AS scv"""


@query("parse_traced_metric", with_("SELECT component, arrival, departure, duration FROM traced", "traced"))
def parse_traced_metric(spark, sf):
    return L.parse_traced(I.traced_lines(spark, sf)).select("component", "arrival", "departure", "duration")


@query("parse_window_metric", with_("""SELECT component, task, cycle AS time, component || ':' || task AS cid, type, stream, cnt, round(total + 3e-7, 4) AS total, round(total_2 + 3e-7, 4) AS total_2
  FROM meas WHERE metric = 'process'""", "meas"))
def parse_window_metric(spark, sf):
    rows = L.explode_process(I.parsed_window(spark, sf), ["component", "task", "time", "cid", "type"])
    return rows.select("component", "task", "time", "cid", "type", "stream", "cnt", *r4("total", "total_2"))


LAYOUTS = """SELECT 'queue' AS layout, component, task, cycle AS time, name, samples FROM sel UNION ALL
  SELECT 'file', component, task, NULL, name, samples FROM sel UNION ALL
  SELECT 'window', component, task, NULL, """ + RENAME + ", samples FROM sel"


@query("encode_metric_line", with_(LAYOUTS, "sel"))
def encode_metric_line(spark, sf):
    """All three line layouts, written and read back."""
    names = list(L.RENAMES)
    points = L.select_metrics(I.metric_points(spark, sf), names).withColumn("json", F.to_json("value"))
    plain = L.encode_lines(points, ["component", "task", "cycle"], "name", "json")
    renamed = L.encode_lines(L.rename_metrics(points), ["component", "task", "cycle"], "name", "json")
    c, t, j = F.col("component"), F.col("task"), F.col("json")
    lines = plain.select(F.explode(F.array(
        F.struct(F.lit("queue").alias("layout"), L.queue_layout(c, t, F.col("cycle"), j).alias("line")),
        F.struct(F.lit("file").alias("layout"), L.file_layout(c, t, j).alias("line")),
    )).alias("x")).select("x.*").unionByName(renamed.select(F.lit("window").alias("layout"), L.window_layout(c, t, j).alias("line")))
    back = L.parse_encoded(lines, "line").select("layout", "component", "task", "time", F.explode("metrics").alias("name", "v"))
    return back.select("layout", "component", "task", "time", "name", F.get_json_object("v", "$.sampleCount").alias("samples"))


LATEST = with_("""SELECT component, task, name, counter, max_by(cnt, cycle) AS cnt, round(max_by(total, cycle) + 3e-7, 4) AS total, max(cycle) AS cycle FROM (
  SELECT component, task, cycle, CASE WHEN component = 'signup' THEN 'complete-latency' ELSE 'execute' END AS name, stream AS counter,
    CAST(CASE WHEN silent THEN 0 ELSE n END AS BIGINT) AS cnt, CASE WHEN silent THEN 0 ELSE t END AS total FROM rep WHERE task <> 3
  UNION ALL SELECT component, task, cycle, '__sendqueue', unnest(['sampleCount', 'totalQueueLen', 'totalCount']), CAST(unnest([n, t, n * 20]) AS BIGINT), NULL
    FROM rmap WHERE task <> 3 AND day % 8 <> 0
  UNION ALL SELECT component, task, cycle, '__receive', unnest(['sampleCount', 'totalQueueLen', 'totalCount']), CAST(unnest(CASE WHEN idle THEN [0, 0, 0] ELSE [n, n * 3 + task, n * 4] END) AS BIGINT), NULL
    FROM rmap WHERE task <> 3 AND day % 9 <> 0) GROUP BY ALL""", "rep", "rmap")


def counters(latest):
    """Counts and totals of stored values: ``count,total,square`` of process maps, plain numbers of queues."""
    parts = F.split("value", ",")
    total = F.round(F.try_element_at(parts, F.lit(2)).cast("double") + 3e-7, 4)
    return latest.select("component", "task", "name", "counter", parts[0].cast("bigint").alias("cnt"), total.alias("total"), "cycle")


@query("latest_metric", LATEST)
def latest_metric(spark, sf):
    """All names and all their counters."""
    points = L.select_metrics(I.metric_points(spark, sf), list(L.RENAMES))
    return counters(M.latest_counters(points, ["component", "task", "name"], "cycle"))


@query("trace_id", with_("SELECT seq, trace || '-' || arrival AS trace_id, CAST(seq AS VARCHAR) AS counter_id FROM exe", "exe"))
def trace_id(spark, sf):
    return I.executions(spark, sf).select("seq", T.trace_id(F.col("trace"), F.col("arrival")).alias("trace_id"), T.trace_id(F.col("seq")).alias("counter_id"))


@query("trace_sample", with_("SELECT seq, trace FROM exe WHERE trace % 10 = 0", "exe"))
def trace_sample(spark, sf):
    return M.sample_traces(I.executions(spark, sf), "trace", 10, F.col("trace")).select("seq", "trace")


@query("metric_select", with_("SELECT component, task, cycle, name, n_keys FROM sel", "sel"))
def metric_select(spark, sf):
    s = L.select_metrics(I.metric_points(spark, sf), list(L.RENAMES))
    return s.select("component", "task", "cycle", "name", F.size("value").cast("bigint").alias("n_keys"))


@query("metric_rename", with_(f"SELECT component, task, cycle, {RENAME} AS name FROM sel", "sel"))
def metric_rename(spark, sf):
    s = L.select_metrics(I.metric_points(spark, sf), list(L.RENAMES))
    return L.rename_metrics(s).select("component", "task", "cycle", "name")


@query("elapsed_positive", with_("SELECT seq, CAST(took - 5 AS DOUBLE) AS elapsed_ms FROM exe WHERE took > 5", "exe"))
def elapsed_positive(spark, sf):
    e = I.executions(spark, sf).select("seq", (F.col("arrival") * 1_000_000).alias("s"), ((F.col("departure") - 5) * 1_000_000).alias("e"))
    return M.elapsed(e, "s", "e").select("seq", F.round("elapsed_ms", 6).alias("elapsed_ms"))


@query("trace_correlate", with_("""SELECT trace, e - s AS latency, component, arrival, departure FROM comp LEFT JOIN some_exe USING (trace)""", "comp", "some_exe"))
def trace_correlate(spark, sf):
    done = I.completions(spark, sf).select("trace", (F.col("end") - F.col("start")).alias("latency"))
    return M.correlate_traces(done, I.some_executions(spark, sf)).select("trace", "latency", "component", "arrival", "departure")


@query("trace_correlate_inner", with_("""SELECT trace, e - s AS latency, component, arrival, departure FROM comp JOIN some_exe USING (trace)""", "comp", "some_exe"))
def trace_correlate_inner(spark, sf):
    done = I.completions(spark, sf).select("trace", (F.col("end") - F.col("start")).alias("latency"))
    rows = M.correlate_traces(done, I.some_executions(spark, sf), keep_unmatched=False)
    return rows.select("trace", "latency", "component", "arrival", "departure")


def paired(spark, sf):
    c = I.completions(spark, sf)
    return M.pair_latency(c.select("trace", "start"), c.where("trace % 17 <> 0").select("trace", "end", "failed"))


@query("pair_latency", with_("SELECT trace, CASE WHEN failed THEN -1 ELSE e - s END AS latency FROM comp WHERE trace % 17 <> 0", "comp"))
def pair_latency(spark, sf):
    """Every seventeenth trace never finishes."""
    return paired(spark, sf)


@query("completed_agg", with_("""SELECT count(*) AS cnt, CAST(sum(e - s) AS DOUBLE) AS total, round(sum(CAST(e - s AS DOUBLE) * (e - s)), -8) AS total_2 FROM comp
  WHERE trace % 17 <> 0 AND NOT failed""", "comp"))
def completed_agg(spark, sf):
    return M.completed_aggregate(paired(spark, sf)).select("cnt", "total", F.round("total_2", -8).alias("total_2"))


@query("trace_collect", with_(f"""SELECT arrival // 60000 * 60000 AS window_start, component, trace, row_number() OVER (
  PARTITION BY arrival // 60000, component, trace ORDER BY 'src:default,' || arrival || ',' || departure) AS pos, 'src:default,' || arrival || ',' || departure AS record FROM exe""", "exe"))
def trace_collect(spark, sf):
    record = F.concat_ws(",", F.lit("src:default"), "arrival", "departure")
    return M.collect_traces(I.executions(spark, sf), 60_000, record, "seq", "arrival")


@query("traced_stats", with_("""SELECT component, count(*) AS cnt, sum(duration) AS total, round(avg(duration) + 3e-7, 4) AS avg,
  round(sum(duration * duration) / count(*) - avg(duration) * avg(duration), CASE WHEN component LIKE '\\_%' ESCAPE '\\' THEN -4 ELSE 3 END) AS var FROM traced GROUP BY 1""", "traced"))
def traced_stats(spark, sf):
    s = M.traced_stats(L.parse_traced(I.traced_lines(spark, sf)))
    return s.select("component", "cnt", "total", *r4("avg"), F.when(F.col("component") == L.COMPLETE, F.round("var", -4)).otherwise(F.round("var", 3)).alias("var"))


@query("traced_avg_simple", with_("""SELECT component, round(avg(CAST(arrival AS DOUBLE)), 1) AS avg FROM traced WHERE component <> '_complete-latency' GROUP BY 1
  UNION ALL SELECT '_complete-latency', CAST(CAST(sum(duration) AS BIGINT) // count(*) AS DOUBLE) FROM traced WHERE component = '_complete-latency'""", "traced"))
def traced_avg_simple(spark, sf):
    return M.traced_avg_simple(I.traced_lines(spark, sf)).select("component", F.round("avg", 1).alias("avg"))


@query("cmv_window", with_(f"""SELECT time // {DAY} * {DAY} AS window_start, component, task, stream, count(*) AS cnt, round(sum(ms) + 3e-7, 4) AS total, round(sum(ms * ms) + 3e-7, 4) AS total_2
  FROM samples GROUP BY ALL""", "samples"))
def cmv_window(spark, sf):
    w = M.cmv_window(I.samples(spark, sf), I.DAY_MS, ["component", "task", "stream"])
    return w.select("window_start", "component", "task", "stream", "cnt", *r4("total", "total_2"))


def day_rows(spark, sf):
    r = I.reports(spark, sf)
    zero = lambda c: F.when(F.col("silent"), 0).otherwise(F.col(c))
    return r.select("component", "task", "stream", "cycle", zero("n").cast("bigint").alias("cnt"), zero("t").cast("double").alias("total"), zero("t2").cast("double").alias("total_2"))


MERGED = """SELECT component, stream, CAST(sum(CASE WHEN silent THEN 0 ELSE n END) AS BIGINT) AS cnt, sum(CASE WHEN silent THEN 0 ELSE t END) AS total,
  sum(CASE WHEN silent THEN 0 ELSE t2 END) AS total_2, CAST(sum(CASE WHEN silent THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM rep GROUP BY ALL"""


@query("cmv_merge", with_(f"SELECT component, stream, cnt, round(total + 3e-7, 4) AS total, round(total_2 + 3e-7, 4) AS total_2, empty FROM ({MERGED})", "rep"))
def cmv_merge(spark, sf):
    """Task partials first, then the merge of the partials."""
    partial = M.cmv_merge_windows(day_rows(spark, sf), ["component", "task", "stream"])
    return M.cmv_merge(partial, ["component", "stream"]).select("component", "stream", "cnt", *r4("total", "total_2"), "empty")


@query("cmv_empty", with_("""SELECT component, task, stream, CAST(sum(CASE WHEN silent THEN 1 ELSE 0 END) AS BIGINT) AS empty,
  CAST(sum(CASE WHEN silent THEN 0 ELSE n END) AS BIGINT) AS cnt FROM rep GROUP BY ALL""", "rep"))
def cmv_empty(spark, sf):
    return M.cmv_merge_windows(day_rows(spark, sf), ["component", "task", "stream"]).select("component", "task", "stream", "empty", "cnt")


@query("cmv_stats", with_(f"SELECT component, stream, cnt, {STATS} FROM ({MERGED})", "rep"))
def cmv_stats(spark, sf):
    s = M.cmv_stats(M.cmv_merge_windows(day_rows(spark, sf), ["component", "stream"]))
    return s.select("component", "stream", "cnt", *r4("avg", "avg2", "var", "scv"))


@query("cmv_format", with_(f"""SELECT component, stream, format('Count: {{:d}}, sum: {{:.2f}}, avg: {{:.5f}}, var: {{:.5f}}, scv: {{:.5f}}, empEn: {{:d}}', cnt, total, total / cnt,
  total_2 / cnt - (total / cnt) * (total / cnt), total_2 / cnt / ((total / cnt) * (total / cnt)) - 1, empty) AS long_text,
  format('cnt:{{:d}},avg:{{:.2f}},scv:{{:.2f}}', cnt, total / cnt, total_2 / cnt / ((total / cnt) * (total / cnt)) - 1) AS short_text FROM ({MERGED})""", "rep"))
def cmv_format(spark, sf):
    s = M.cmv_merge_windows(day_rows(spark, sf), ["component", "stream"])
    return s.select("component", "stream", cmv.long_string().alias("long_text"), cmv.short_string().alias("short_text"))


def measured(spark, sf, *keep):
    return M.measurements(I.parsed_window(spark, sf), [*keep, "component", "task", "type"])


PER = """SELECT component || ':' || task AS cid, type, {k}, cnt, round(total + 3e-7, 4) AS total, round(total_2 + 3e-7, 4) AS total_2, empty, """ + STATS + """ FROM (
  SELECT component, task, type, {k}, CAST(sum(cnt) AS BIGINT) AS cnt, sum(total) AS total, sum(total_2) AS total_2, CAST(sum(empty) AS BIGINT) AS empty
  FROM meas WHERE metric {op} 'process' GROUP BY ALL)"""


@query("process_stats", with_(PER.format(k="stream", op="="), "meas"))
def process_stats(spark, sf):
    s = M.process_stats(I.parsed_window(spark, sf))
    return s.select("cid", "type", "stream", "cnt", *r4("total", "total_2"), "empty", *r4("avg", "avg2", "var", "scv"))


@query("queue_stats", with_(PER.format(k="metric", op="<>"), "meas"))
def queue_stats(spark, sf):
    s = M.queue_stats(I.parsed_window(spark, sf))
    return s.select("cid", "type", "metric", "cnt", *r4("total", "total_2"), "empty", *r4("avg", "avg2", "var", "scv"))


@query("component_rollup", with_(f"SELECT component, type, metric, stream, {SUMS} FROM meas GROUP BY ALL", "meas"))
def component_rollup(spark, sf):
    return M.component_rollup(measured(spark, sf)).select("component", "type", "metric", "stream", "cnt", *r4("total", "total_2"), "empty")


@query("combine_streams", with_(f"SELECT component, type, {SUMS} FROM meas WHERE metric = 'process' GROUP BY ALL", "meas"))
def combine_streams(spark, sf):
    return M.combine_streams(measured(spark, sf)).select("component", "type", "cnt", *r4("total", "total_2"), "empty")


@query("known_components", with_("SELECT DISTINCT component, task, type FROM meas WHERE task < 3", "meas"))
def known_components(spark, sf):
    rows = I.parsed_window(spark, sf).select("component", "task", "type").distinct()
    return M.known_components(rows, I.cluster(spark, sf))


# Each task's daily report, repeated on the days it was silent.
FFILL = f"""SELECT g.component, g.task, g.type, g.cycle, r.cycle AS reported_cycle, r.metric, r.stream, r.cnt, r.total, r.total_2, r.empty FROM (
  SELECT t.component, t.task, t.type, c.cycle, max(t.cycle) AS src FROM (SELECT DISTINCT component, task, type, cycle FROM meas) t
  JOIN (SELECT DISTINCT cycle FROM meas) c ON t.cycle <= c.cycle GROUP BY ALL) g
  JOIN meas r ON r.component = g.component AND r.task = g.task AND r.type = g.type AND r.cycle = g.src"""
ROLLED = f"""SELECT component, type, cycle, metric, stream, CAST(sum(cnt) AS BIGINT) AS cnt, sum(total) AS total, sum(total_2) AS total_2,
  CAST(sum(empty) AS BIGINT) AS empty FROM ({FFILL}) GROUP BY ALL"""


def filled(spark, sf):
    """Reports with their measurements, repeated over silent days."""
    parsed = I.parsed_window(spark, sf).withColumnRenamed("time", "cycle")
    spread = M.snapshot_ffill(parsed, ["component", "task", "type"])
    return M.measurements(spread, ["component", "task", "type", "cycle", "reported_cycle"])


def history_rows(spark, sf):
    return M.component_rollup(filled(spark, sf), ["cycle"])


@query("snapshot_ffill", with_(f"SELECT component, type, cycle, metric, stream, cnt, round(total + 3e-7, 4) AS total, round(total_2 + 3e-7, 4) AS total_2, empty FROM ({ROLLED})", "meas"))
def snapshot_ffill(spark, sf):
    return history_rows(spark, sf).select("component", "type", "cycle", "metric", "stream", "cnt", *r4("total", "total_2"), "empty")


HISTORY = f"""SELECT component, type, metric, stream, cycle, CAST(sum(cnt) OVER w AS BIGINT) AS cnt, sum(total) OVER w AS total, sum(total_2) OVER w AS total_2,
  CAST(sum(empty) OVER w AS BIGINT) AS empty, count(*) OVER w AS cycles FROM ({ROLLED})
  WINDOW w AS (PARTITION BY component, type, metric, stream ORDER BY cycle ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""


def history(spark, sf):
    return M.rolling_history(history_rows(spark, sf), ["component", "type", "metric", "stream"])


@query("rolling_history", with_(f"SELECT component, type, metric, stream, cycle, cnt, round(total + 3e-7, 4) AS total, round(total_2 + 3e-7, 4) AS total_2, empty, cycles FROM ({HISTORY})", "meas"))
def rolling_history(spark, sf):
    return history(spark, sf).select("component", "type", "metric", "stream", "cycle", "cnt", *r4("total", "total_2"), "empty", "cycles")


LOADED = f"""SELECT component, type, cycle, 3 AS n_tasks, ac, arr, pc, pt, CASE WHEN sc = 0 THEN 0 ELSE st / sc END AS send_len, CASE WHEN rc = 0 THEN 0 ELSE rt / rc END AS recv_len,
    CASE WHEN ac = 0 THEN 0 ELSE arr / ac END / 10.0 AS rate, CASE WHEN pc = 0 THEN 0 ELSE pt / pc END AS avg_ms FROM (
  SELECT component, type, cycle, sum(cnt) FILTER (WHERE metric = 'recv-queue-arrivals') AS ac, sum(total) FILTER (WHERE metric = 'recv-queue-arrivals') AS arr,
    coalesce(sum(cnt) FILTER (WHERE metric = 'process'), 0) AS pc, coalesce(sum(total) FILTER (WHERE metric = 'process'), 0) AS pt,
    sum(cnt) FILTER (WHERE metric = 'send-queue-length') AS sc, sum(total) FILTER (WHERE metric = 'send-queue-length') AS st,
    sum(cnt) FILTER (WHERE metric = 'recv-queue-length') AS rc, sum(total) FILTER (WHERE metric = 'recv-queue-length') AS rt FROM ({{}}) GROUP BY ALL)"""
LOAD_SQL = """SELECT component, type, cycle, CAST(n_tasks AS BIGINT) AS n_tasks, round(rate * 3 + 3e-7, 4) AS lam, round(CASE WHEN avg_ms = 0 THEN 'Infinity'::DOUBLE ELSE 1000 / avg_ms END + 3e-7, 4) AS mu,
  round(rate * avg_ms / 1000 + 3e-9, 6) AS rho, round(CASE WHEN pc = 0 THEN 0 ELSE (arr - ac) / pc END + 3e-7, 4) AS input_ratio FROM ({})"""


@query("svc_load", with_(LOAD_SQL.format(LOADED.format(HISTORY)), "meas"))
def svc_load(spark, sf):
    """Load over the last four cycles of each component."""
    load = C.service_load(history(spark, sf), tasks(spark, sf), 10.0, ("cycle",))
    return load.select("component", "type", "cycle", "n_tasks", *r4("lam", "mu", "input_ratio"), F.round(F.col("rho") + 3e-9, 6).alias("rho"))


@query("svc_flags", with_(f"""SELECT component, type, cycle, send_len < 30 AS send_ok, recv_len < 0.006 * 512 AS recv_ok,
  CASE WHEN type = 'spout' THEN avg_ms < 20 END AS qos_ok FROM ({LOADED.format(ROLLED)})""", "meas"))
def svc_flags(spark, sf):
    load = C.service_load(history_rows(spark, sf), tasks(spark, sf), 10.0, ("cycle",))
    flags = C.load_flags(load, qos_ms=20.0, send_limit=30.0, recv_ratio=0.006, recv_size=512)
    return flags.select("component", "type", "cycle", "send_ok", "recv_ok", "qos_ok")


def load_table(spark, sf):
    return M.execution_load(I.parsed_window(spark, sf))


@query("execution_load", with_("SELECT key, component, task, cnt, round(cost + 3e-7, 4) AS cost FROM load", "load"))
def execution_load(spark, sf):
    return load_table(spark, sf).select("key", "component", "task", "cnt", *r4("cost"))


@query("key_prefix_range", with_("SELECT key, cnt FROM load WHERE key >= 'click' AND key < 'click;'", "load"))
def key_prefix_range(spark, sf):
    return M.key_prefix_range(load_table(spark, sf), "click").select("key", "cnt")


@query("avg_task_count", with_("SELECT component, round(avg(cnt) + 3e-7, 4) AS avg FROM load GROUP BY 1", "load"))
def avg_task_count(spark, sf):
    return load_table(spark, sf).groupBy("component").agg(F.round(F.avg("cnt") + 3e-7, 4).alias("avg"))


@query("even_groups", with_("""SELECT component, tile, CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(cost) + 3e-7, 4) AS cost FROM (
  SELECT *, ntile(3) OVER (PARTITION BY component ORDER BY key) AS tile FROM load) GROUP BY ALL""", "load"))
def even_groups(spark, sf):
    tiled = M.even_groups(load_table(spark, sf), 3, ["component"], "task")
    return tiled.groupBy("component", "tile").agg(F.sum("cnt").alias("cnt"), F.round(F.sum("cost") + 3e-7, 4).alias("cost"))


@query("even_groups_items", with_("SELECT grp, idx, ntile(7) OVER (PARTITION BY grp ORDER BY idx) AS tile FROM items", "items"))
def even_groups_items(spark, sf):
    return M.even_groups(I.items(spark, sf), 7, ["grp"], "idx").select("grp", "idx", "tile")


@query("greedy_segments", """WITH RECURSIVE m AS (SELECT event_type AS component, (epoch_us(ts) // 1000) AS time, value FROM events),
  nxt AS (SELECT DISTINCT component, time, min(time) OVER (PARTITION BY component ORDER BY time RANGE BETWEEN 21600001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m),
  cuts AS (SELECT component, min(time) AS time FROM m GROUP BY 1 UNION ALL SELECT c.component, n.next FROM cuts c JOIN nxt n ON c.component = n.component AND c.time = n.time WHERE n.next IS NOT NULL),
  seg AS (SELECT component, time AS start_time, lead(time) OVER (PARTITION BY component ORDER BY time) AS end_time, row_number() OVER (PARTITION BY component ORDER BY time) AS segment FROM cuts)
  SELECT s.component, s.segment, s.start_time, s.end_time, count(*) AS cnt, round(sum(value) + 3e-7, 4) AS load FROM seg s JOIN m ON m.component = s.component
    AND m.time >= s.start_time AND m.time < s.end_time GROUP BY ALL""")
def greedy_segments(spark, sf):
    s = M.greedy_segments(I.marks(spark, sf), 21_600_000, "value")
    return s.select("component", "segment", "start_time", "end_time", "cnt", *r4("load"))


@query("numeric_stats", "SELECT count(*) AS cnt, round(sum(value) + 3e-7, 4) AS total, round(avg(value) + 3e-7, 4) AS avg, round(var_pop(value) + 3e-7, 4) AS var FROM events WHERE event_id % 50 <> 0")
def numeric_stats(spark, sf):
    from ..sources.records import parse_numeric_lines

    s = M.numeric_stats(parse_numeric_lines(I.number_lines(spark, sf)), "w")
    return s.select("cnt", *r4("total", "avg", "var"))


@query("expand_ranges", "SELECT DISTINCT event_type AS component, unnest([0, 1, 2]) AS task FROM events")
def expand_ranges(spark, sf):
    return M.expand_ranges(I.executors(spark, sf))


@query("tasks_by_component", "SELECT DISTINCT event_type AS component, '0,1,2' AS tasks FROM events WHERE event_type <> 'signup'")
def tasks_by_component(spark, sf):
    t = M.tasks_by_component(I.executors(spark, sf), ~M.is_system() & (F.col("component") != "signup"))
    return t.select("component", F.array_join(F.transform("tasks", lambda x: x.cast("string")), ",").alias("tasks"))


QUANTILES = [0.5, 0.9, 0.99]


@query("latency_quantiles", with_("""SELECT component, q, round(CASE WHEN ms = 0 THEN 0 ELSE sign(ms) * 2 * pow(1.01 / 0.99, ceil(ln(abs(ms)) / ln(1.01 / 0.99))) / (1.01 / 0.99 + 1) END, 4) AS ms FROM (
  SELECT component, ms, row_number() OVER (PARTITION BY component ORDER BY ms) - 1 AS place, count(*) OVER (PARTITION BY component) AS n FROM samples WHERE ms IS NOT NULL)
  JOIN (SELECT CAST(unnest([0.5, 0.9, 0.99]) AS DOUBLE) AS q) ON place = floor(q * (n - 1))""", "samples"))
def latency_quantiles(spark, sf):
    """Quantiles of the times of each component, within 1 %, by a reducer that merges bucket counts."""
    got = reduce_by_key(I.samples(spark, sf), ["component"], "ms", Quantiles(QUANTILES, 0.01))
    at = F.array(*[F.lit(q) for q in QUANTILES])
    return got.select("component", F.explode(F.arrays_zip(at.alias("q"), F.col("result").alias("ms"))).alias("x")).select("component", "x.q", F.round("x.ms", 4).alias("ms"))
