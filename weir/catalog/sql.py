"""The canonical inputs once more, as SQL common table expressions for the checks."""

DAY = "86400000"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body)


def with_(body: str, *needs: str) -> str:
    """``body`` behind the CTEs it needs, dependencies first."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


TOKENS = r"list_filter(string_split_regex({0}, '[ \t\n\r\f]+'), lambda x: x <> '')"
CLEAN = r"regexp_replace({0}, '\p{{P}}|\p{{S}}', ' ', 'g')"


def tokens(expr: str) -> str:
    return TOKENS.format(expr)


def clean(expr: str) -> str:
    return CLEAN.format(expr)


cte("sentences", "SELECT doc_id AS seq, text AS sentence FROM documents")
cte("tok", f"""SELECT seq, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word
  FROM (SELECT seq, {tokens('sentence')} AS ws FROM sentences)""", "sentences")
cte("wc", "SELECT word, count(*) AS cnt FROM tok GROUP BY word", "tok")
cte("stop", f"""SELECT word FROM (SELECT lower(w) AS word, count(*) AS c FROM (
  SELECT unnest({tokens(clean('text'))}) AS w FROM benchmark) GROUP BY 1 ORDER BY c DESC, word LIMIT 20)""")
cte("queue", """SELECT event_id AS seq, (epoch_us(ts) // 1000) AS time, CASE WHEN event_id % 7 = 0 THEN '-' ELSE '+' END || event_type AS text,
  value FROM events""")

cte("dict", "SELECT word, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT p_brand AS word FROM part)")
cte("bw", "SELECT DISTINCT l_orderkey AS seq, p_brand AS word FROM lineitem JOIN part ON l_partkey = p_partkey")
cte("adds", "SELECT seq, list_sort(list(id)) AS ids FROM bw JOIN dict USING (word) GROUP BY seq", "bw", "dict")
cte("net", """SELECT ids, sum(CASE WHEN seq % 5 = 0 THEN 0 ELSE 1 END) AS n FROM adds GROUP BY ids
  HAVING sum(CASE WHEN seq % 5 = 0 THEN 0 ELSE 1 END) <> 0""", "adds")
PICK = "list_transform(list_filter(range(0, len(ids)), lambda i: (m >> i) & 1 = 1), lambda i: ids[i + 1])"
cte("pc", f"""SELECT pattern, CAST(sum(n) AS BIGINT) AS cnt FROM (
  SELECT n, {PICK} AS pattern FROM (SELECT ids, n, unnest(generate_series(1, (1 << len(ids)) - 1)) AS m FROM net))
  GROUP BY pattern""", "net")
cte("freq", "SELECT pattern, cnt FROM pc WHERE cnt >= 50", "pc")
DROP_ONE = "SELECT DISTINCT list_filter(pattern, lambda x: x <> d) AS pattern FROM (SELECT pattern, unnest(pattern) AS d FROM {0})"
cte("maxi", f"SELECT * FROM freq ANTI JOIN ({DROP_ONE.format('freq')}) USING (pattern)", "freq")
cte("pc_add", f"""SELECT pattern, count(*) AS cnt FROM (
  SELECT {PICK} AS pattern FROM (SELECT ids, unnest(generate_series(1, (1 << len(ids)) - 1)) AS m FROM adds))
  GROUP BY pattern""", "adds")
cte("freq_add", "SELECT pattern, cnt FROM pc_add WHERE cnt >= 50", "pc_add")
cte("maxi_add", f"SELECT * FROM freq_add ANTI JOIN ({DROP_ONE.format('freq_add')}) USING (pattern)", "freq_add")

cte("objects", "SELECT vec_id AS seq, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
cte("proj", """SELECT seq, id, p AS projection_id,
  list_sum([v[j + 1] * 0.125 * (1 - 2 * (bit_count(CAST(p AS INTEGER) & CAST(j AS INTEGER)) % 2)) for j in range(0, 64)]) AS pv
  FROM objects, (SELECT unnest(range(0, 8)) AS p)""", "objects")
cte("neigh", """SELECT a.projection_id, a.id, count(*) - 1 AS neighbors FROM proj a JOIN proj b
  ON a.projection_id = b.projection_id AND abs(a.pv - b.pv) <= 0.02 GROUP BY ALL""", "proj")

cte("samples", """SELECT (epoch_us(ts) // 1000) AS time, event_type AS component, CAST(user_id % 4 AS INTEGER) AS task,
  CASE WHEN event_id % 3 = 0 THEN 'side' ELSE 'default' END AS stream, value AS ms FROM events""")
cte("rep", f"""SELECT component, task, time // {DAY} * {DAY} AS cycle, stream, count(*) AS n, round(sum(ms), 6) AS t,
  round(sum(ms * ms), 6) AS t2, stream = 'side' AND (time // {DAY} + task) % 7 = 1 AS silent FROM samples GROUP BY ALL""", "samples")
cte("rmap", f"""SELECT component, task, cycle, cycle // {DAY} AS day, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(t)) AS BIGINT) AS t,
  (cycle // {DAY} + task) % 6 = 0 AS idle FROM rep GROUP BY ALL""", "rep")
GOOD = "NOT (day % 13 = 0 AND task = 2) AND NOT (day % 11 = 0 AND task = 3)"
cte("meas", f"""SELECT component, task, cycle, CASE WHEN component = 'signup' THEN 'spout' ELSE 'bolt' END AS type, metric, stream,
    CAST(cnt AS BIGINT) AS cnt, total, total_2, empty FROM (
  SELECT component, task, cycle, cycle // {DAY} AS day, 'process' AS metric, stream, CASE WHEN silent THEN 0 ELSE n END AS cnt,
    CASE WHEN silent THEN 0 ELSE t END AS total, CASE WHEN silent THEN 0 ELSE t2 END AS total_2, CASE WHEN silent THEN 1 ELSE 0 END AS empty FROM rep
  UNION ALL SELECT component, task, cycle, day, 'send-queue-length', '', 1, t / n, (t / n) * (t / n), 0 FROM rmap
  UNION ALL SELECT component, task, cycle, day, 'send-queue-samples', '', 1, n, n * n, 0 FROM rmap
  UNION ALL SELECT component, task, cycle, day, 'send-queue-arrivals', '', 1, n * 20, n * 20 * n * 20, 0 FROM rmap
  UNION ALL SELECT component, task, cycle, day, 'recv-queue-length', '', CASE WHEN idle THEN 0 ELSE 1 END,
    CASE WHEN idle THEN 0 ELSE (n * 3 + task) / n END, CASE WHEN idle THEN 0 ELSE ((n * 3 + task) / n) * ((n * 3 + task) / n) END, CASE WHEN idle THEN 1 ELSE 0 END FROM rmap
  UNION ALL SELECT component, task, cycle, day, 'recv-queue-samples', '', CASE WHEN idle THEN 0 ELSE 1 END,
    CASE WHEN idle THEN 0 ELSE n END, CASE WHEN idle THEN 0 ELSE n * n END, CASE WHEN idle THEN 1 ELSE 0 END FROM rmap
  UNION ALL SELECT component, task, cycle, day, 'recv-queue-arrivals', '', CASE WHEN idle THEN 0 ELSE 1 END,
    CASE WHEN idle THEN 0 ELSE n * 4 END, CASE WHEN idle THEN 0 ELSE n * n * 16 END, CASE WHEN idle THEN 1 ELSE 0 END FROM rmap
  ) WHERE {GOOD}""", "rep", "rmap")
SUMS = "CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(total) + 3e-7, 4) AS total, round(sum(total_2) + 3e-7, 4) AS total_2, CAST(sum(empty) AS BIGINT) AS empty"
cte("points", f"""SELECT CASE WHEN task = 3 THEN '__acker' ELSE component END AS component, task, cycle, name, n_keys, samples FROM (
  SELECT r.component, r.task, r.cycle, CASE WHEN r.component = 'signup' THEN 'complete-latency' ELSE 'execute' END AS name,
    s.k AS n_keys, CAST(NULL AS VARCHAR) AS samples
  FROM rmap r JOIN (SELECT component, task, cycle, count(*) AS k FROM rep GROUP BY ALL) s USING (component, task, cycle)
  UNION ALL SELECT component, task, cycle, '__sendqueue', CASE WHEN day % 8 = 0 THEN 0 ELSE 3 END, CASE WHEN day % 8 = 0 THEN NULL ELSE CAST(n AS VARCHAR) END FROM rmap
  UNION ALL SELECT component, task, cycle, '__receive', CASE WHEN day % 9 = 0 THEN NULL ELSE 3 END,
    CASE WHEN day % 9 = 0 THEN NULL WHEN idle THEN '0' ELSE CAST(n AS VARCHAR) END FROM rmap
  UNION ALL SELECT component, task, cycle, '__emit-count', 3, CAST(n AS VARCHAR) FROM rmap)""", "rep", "rmap")
cte("sel", """SELECT * FROM points WHERE component NOT LIKE '\\_\\_%' ESCAPE '\\' AND n_keys > 0
  AND name IN ('__sendqueue', '__receive', 'complete-latency', 'execute')""", "points")
RENAME = "CASE name WHEN '__sendqueue' THEN 'send-queue' WHEN '__receive' THEN 'recv-queue' ELSE name END"

cte("exe", """SELECT event_id AS seq, event_id // 5 AS trace, event_type AS component, (epoch_us(ts) // 1000) AS arrival,
  CAST(round(value) AS BIGINT) AS took, (epoch_us(ts) // 1000) + CAST(round(value) AS BIGINT) AS departure FROM events""")
cte("some_exe", "SELECT * FROM exe WHERE trace % 11 <> 0", "exe")
cte("comp", """SELECT event_id // 5 AS trace, min((epoch_us(ts) // 1000)) AS s, max((epoch_us(ts) // 1000) + CAST(round(value) AS BIGINT)) AS e,
  (event_id // 5) % 13 = 0 AS failed FROM events GROUP BY ALL""")
cte("traced", """SELECT trace, '_complete-latency' AS component, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS BIGINT) AS departure, CAST(e - s AS DOUBLE) AS duration
    FROM comp WHERE trace % 97 <> 0
  UNION ALL SELECT trace, component, arrival, departure, CAST(departure - arrival AS DOUBLE) FROM exe WHERE trace % 97 <> 0""", "exe", "comp")

cte("svc", """SELECT topology, cid, lam, mu, kind, CAST(CASE WHEN t = 3 THEN 1 ELSE floor(lam / mu) + 1 + length(cid) % 2 END AS BIGINT) AS k FROM (
  SELECT t, 't' || t AS topology, event_type AS cid, n / 720.0 AS lam, 1.25 * (n / 720.0) / (1 + length(event_type) % 3) AS mu,
    CASE WHEN length(event_type) % 3 = 0 THEN 'Exponential' WHEN length(event_type) % 3 = 1 THEN 'Deterministic'
      WHEN event_type = 'click' THEN 'Uniform' ELSE 'Fixed' END AS kind
  FROM (SELECT user_id % 10 AS t, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL))""")
cte("svck", "SELECT *, CAST(floor(lam / mu) + 1 AS BIGINT) AS min_k FROM svc", "svc")
UNBOUNDED = "CAST(1.7976931348623157e308 AS DOUBLE)"


def erlang(k: str) -> str:
    """Closed-form M/M/k sojourn time."""
    a = "(lam / mu)"
    tail = f"(pow({a}, {k}) / factorial(CAST({k} AS INTEGER)) / (1 - lam / (mu * {k})))"
    head = f"list_sum([pow({a}, i) / factorial(CAST(i AS INTEGER)) for i in range(0, {k})])"
    return f"CASE WHEN lam >= mu * {k} THEN {UNBOUNDED} ELSE {tail} / ({head} + {tail}) / (mu * {k} - lam) + 1 / mu END"


cte("chain", f"""SELECT topology, sum(CASE WHEN t < {UNBOUNDED} THEN t END) AS s, bool_and(t < {UNBOUNDED}) AS stable
  FROM (SELECT topology, {erlang('k')} AS t FROM svck) GROUP BY topology""", "svck")
cte("totals", "SELECT topology, CAST(sum(min_k) AS BIGINT) AS min_total, CAST(sum(k) AS BIGINT) AS plan_total FROM svck GROUP BY topology", "svck")
cte("goals", """SELECT topology, sum(1 / mu) AS floor_s, sum(1 / mu) * 1000 * CASE WHEN CAST(substr(topology, 2) AS INTEGER) % 4 = 1 THEN 1.2 ELSE 2.2 END AS qos_ms,
  sum(1 / mu) * 1500 AS real_ms FROM svc GROUP BY topology""", "svc")


def min_plan(targets: str, name: str) -> None:
    """Greedy by ranked gains with a generous number of extra servers."""
    cte(name + "_base", f"""SELECT s.*, g.target_s, g.adj, sum(1 / s.mu) OVER (PARTITION BY topology) AS floor_s,
      sum({erlang('min_k')}) OVER (PARTITION BY topology) AS base_s FROM svck s JOIN {targets} g USING (topology)""", "svck", targets)
    cte(name + "_gain", f"""SELECT topology, cid, step, gain, base_s, target_s, adj, row_number() OVER (PARTITION BY topology ORDER BY gain DESC, cid, step) AS rk
      FROM (SELECT *, {erlang('(min_k + step - 1)')} - {erlang('(min_k + step)')} AS gain FROM {name}_base, (SELECT unnest(range(1, 26)) AS step))""", name + "_base")
    cte(name, f"""SELECT b.topology, b.cid, CASE WHEN floor_s * adj < target_s AND floor_s <= target_s THEN min_k + coalesce(won, 0) END AS k FROM {name}_base b LEFT JOIN (
      SELECT topology, cid, count(*) AS won FROM (SELECT *, (base_s - coalesce(sum(gain) OVER (PARTITION BY topology ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * adj AS before
        FROM {name}_gain) WHERE before > target_s GROUP BY ALL) w USING (topology, cid)""", name + "_gain")


cte("target_a", """SELECT topology, CASE WHEN topology = 't8' THEN 0.5 ELSE 1.3 END * sum(1 / mu) AS target_s, 1.1 AS adj FROM svc GROUP BY topology""", "svc")
min_plan("target_a", "plan_a")
cte("target_r", f"""SELECT topology, qos_ms / 1000 AS target_s, greatest(1, real_ms / CASE WHEN stable THEN s * 1000 ELSE {UNBOUNDED} END) AS adj
  FROM chain JOIN goals USING (topology)""", "chain", "goals")
min_plan("target_r", "plan_r")

cte("states", "SELECT user_id AS entity, event_id AS seq, event_type AS state FROM events")
cte("trans", """SELECT from_state, to_state, count(*) AS cnt, count(*) / (SELECT count(*) FROM states) AS p FROM (
  SELECT state AS to_state, lag(state) OVER (PARTITION BY entity ORDER BY seq) AS from_state FROM states) WHERE from_state IS NOT NULL GROUP BY ALL""", "states")
cte("items", """SELECT p_brand AS grp, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, w, size FROM part JOIN (
  SELECT l_partkey, sum(l_quantity) AS w, round(sum(l_extendedprice), 2) AS size FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
cte("plans", """SELECT grp, plan_id, bucket, n // plan_id + CASE WHEN bucket <= n % plan_id THEN 1 ELSE 0 END AS size FROM (
  SELECT grp, count(*) AS n, unnest([4, 6, 8]) AS plan_id FROM items GROUP BY grp), LATERAL (SELECT unnest(generate_series(1, plan_id)) AS bucket)""", "items")
cte("ranges", """SELECT grp, plan_id, bucket, s - size AS lo, s - 1 AS hi FROM (
  SELECT *, CAST(sum(size) OVER (PARTITION BY grp, plan_id ORDER BY bucket) AS BIGINT) AS s FROM plans)""", "plans")
cte("placed", "SELECT i.*, r.plan_id, r.bucket FROM items i JOIN ranges r ON i.grp = r.grp AND i.idx BETWEEN r.lo AND r.hi", "items", "ranges")
cte("overlap", """SELECT a.grp, a.plan_id AS plan_a, b.plan_id AS plan_b, a.bucket AS bucket_a, b.bucket AS bucket_b, sum(a.size) AS overlap
  FROM placed a JOIN placed b ON a.grp = b.grp AND a.idx = b.idx AND a.plan_id <> b.plan_id GROUP BY ALL""", "placed")
cte("cost", """SELECT grp, plan_a, plan_b, sum(CASE WHEN bucket_a = bucket_b THEN overlap ELSE 0 END) AS kept, any_value(total) AS total
  FROM overlap JOIN (SELECT grp, sum(size) AS total FROM items GROUP BY grp) USING (grp) GROUP BY ALL""", "overlap", "items")
cte("load", f"""SELECT component || ':' || lpad(CAST(task AS VARCHAR), 3, '0') AS key, component, task, CAST(sum(cnt) AS BIGINT) AS cnt, sum(total) AS cost
  FROM meas WHERE type = 'bolt' AND metric = 'process' AND cnt > 0 GROUP BY ALL""", "meas")
