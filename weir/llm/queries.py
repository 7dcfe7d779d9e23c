"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import align, bpe, divergence, imatch, kdtree, lines, mixing, passages, pii, quality, simhash, toxicity, whiten
from .common import fold_of, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(small_batches(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document; ``pieces`` has shard:position:word_from:word_to of each piece, comma-joined."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed, pieces = mixing.mix(docs)
    parts = F.transform("pieces", lambda p: F.concat_ws(":", *[p[c].cast("string") for c in ("shard", "position", "word_from", "word_to")]))
    return mixing.taken(placed, pieces).select("doc_id", "size", "source_size", "target", "taken", "source", F.array_join(parts, ",").alias("pieces"))


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text; the ids travel packed, so the digests need no Python."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs).drop("text"))
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on rows outside the fold of remainder 0, score every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(toxicity_sample(docs, labels))
    return toxicity.score(docs, model).select(
        "doc_id",
        (fold_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def toxicity_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int = 5000) -> DataFrame:
    """The texts of the sampled labels. The sample has at most 2 x rows_per_label rows, so it may be broadcast."""
    chosen = toxicity.training_sample(labels.where(F.col("doc_id").isNotNull()), "label", rows_per_label, "doc_id")
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


@query("op4_imatch")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited(table(spark, sf_dir, "documents"))


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs).select("doc_id", "pii.base", "pii.spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op6_lines")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup and the numbers of the deleted lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.deduplicate(docs, gone="deleted_lines").select("doc_id", "text", "deleted_lines", F.size("deleted_lines").cast("long").alias("n_deleted"))


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5"""


@query("op7_kdtree", TOP_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_passages")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or more: spans of words that occur earlier in the corpus."""
    spans = passages.repeated(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", F.col("start").alias("word_start"), F.col("end").alias("word_end"), (F.col("end") - F.col("start")).alias("n_words"), "first_doc_id")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return simhash.near_duplicates(docs).select("doc_id", hexed, "component_id")


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on rows outside the fold of remainder 2, score every text. Statistics are computed once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialize(quality.statistics_of(docs).drop("text"))
    labels = table(spark, sf_dir, "labels").where(fold_of("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(stats.join(labels, "doc_id"))
    return quality.score(stats, model).select(
        "doc_id",
        (fold_of("doc_id", 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 whitened components of every vector; components are fitted on all vectors."""
    whole = whiten.whole_vectors(table(spark, sf_dir, "embeddings"))
    return whiten.whiten(whole).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align both tokenizers on every text, then weigh each link by its id pair's count in the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.scored(align.align(docs)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# The limits, classes and slack are those of divergence.py.
DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
c0 AS (SELECT *, regexp_replace(t, '[a-z]+', '', 'g') AS t1 FROM w),
c1 AS (SELECT *, regexp_replace(t1, '[A-Z]+', '', 'g') AS t2 FROM c0),
c2 AS (SELECT *, regexp_replace(t2, '[ \\x09-\\x0D]+', '', 'g') AS t3 FROM c1),
c3 AS (SELECT *, regexp_replace(t3, '[.,;:?!''"()\\-]+', '', 'g') AS t4 FROM c2),
c4 AS (SELECT *, regexp_replace(t4, '[0-9]+', '', 'g') AS t5 FROM c3),
c5 AS (SELECT *, regexp_replace(t5, '[\\x00-\\x7F]+', '', 'g') AS t6 FROM c4),
f AS (SELECT rid, doc_id, lang, w, len(w) AS n, length(t) AS chars,
  [length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5) - length(t6), length(t6)] AS cls,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS lines FROM c5),
tok AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM f),
win AS (SELECT rid, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
win2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS again FROM win WHERE z IS NOT NULL),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win2 WHERE again >= 2) GROUP BY 1),
r AS (SELECT * FROM f WHERE n >= 50),
lw AS (SELECT lang, count(*) AS texts, sum(n * floor(1e9 / n)) AS words FROM r GROUP BY 1 HAVING count(*) >= 20),
sw AS (SELECT lang, key, sum(floor(1e9 / n)) AS weight FROM (SELECT lang, n, unnest(list_transform(w, lambda x: lower(x))) AS key FROM r) GROUP BY 1, 2),
top AS (SELECT sw.lang, key, weight / words AS q FROM sw JOIN lw ON sw.lang IS NOT DISTINCT FROM lw.lang QUALIFY row_number() OVER (PARTITION BY sw.lang ORDER BY weight DESC, key) <= 32),
other AS (SELECT lang, greatest(0, 1 - sum(q)) AS q FROM top GROUP BY 1),
sc AS (SELECT lang, k, sum(floor(cls[k] * 1e9 / chars)) AS weight FROM (SELECT lang, cls, chars, unnest(range(1, 8)) AS k FROM r) GROUP BY 1, 2),
qc AS (SELECT sc.lang, k, weight / sum(weight) OVER (PARTITION BY sc.lang) AS q FROM sc JOIN lw ON sc.lang IS NOT DISTINCT FROM lw.lang),
hit AS (SELECT rid, lang, n, lower(x) AS key, count(*) AS c FROM (SELECT rid, lang, n, unnest(w) AS x FROM r) GROUP BY ALL),
bins AS (SELECT h.rid, c / h.n AS p, q FROM hit h JOIN top ON h.lang IS NOT DISTINCT FROM top.lang AND h.key = top.key),
mass AS (SELECT rid, sum(p) AS p, sum(q) AS q, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2 AS d FROM bins GROUP BY 1),
jw AS (SELECT r.rid, coalesce(m.d, 0) + CASE WHEN 1 - coalesce(m.p, 0) > 1e-12 THEN
    ((1 - coalesce(m.p, 0)) * log2(2 * (1 - coalesce(m.p, 0)) / (1 - coalesce(m.p, 0) + o.q)) + CASE WHEN o.q > 0 THEN o.q * log2(2 * o.q / (1 - coalesce(m.p, 0) + o.q)) ELSE 0 END) / 2
    + greatest(0, 1 - coalesce(m.q, 0) - o.q) / 2 ELSE greatest(0, 1 - m.q) / 2 END AS d
  FROM r JOIN other o ON r.lang IS NOT DISTINCT FROM o.lang LEFT JOIN mass m USING (rid)),
jc AS (SELECT rid, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS d FROM (
  SELECT r.rid, r.chars, cls[k] / r.chars AS p, q FROM r JOIN qc ON r.lang IS NOT DISTINCT FROM qc.lang) GROUP BY 1),
m AS (SELECT f.*, coalesce(n_repeat, 0) AS n_repeat, n < 50 OR 100 * coalesce(n_repeat, 0) > 50 * n AS base_failed,
  sqrt(greatest(0, jw.d - 3.0 * 32 / (8 * ln(2)) / greatest(n, 1))) AS dw, CASE WHEN f.chars >= 200 THEN sqrt(greatest(0, jc.d - 3.0 * 6 / (8 * ln(2)) / f.chars)) END AS dc
  FROM f LEFT JOIN rep USING (rid) LEFT JOIN jw USING (rid) LEFT JOIN jc USING (rid))
SELECT doc_id, n::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  n_repeat::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(dc <= 0.3, true) AND coalesce(dw <= 0.2, true) AS kept FROM m"""


@query("op13_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return divergence.judge(docs).select("doc_id", *divergence.MEASURES, "base_failed", "kept")
