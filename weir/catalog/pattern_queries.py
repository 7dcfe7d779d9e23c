"""Basket and pattern queries."""

from pyspark.sql import functions as F

from ..functions.arrays import joined
from ..operators import flips as X
from ..operators import outliers as O
from ..operators import patterns as P
from ..scale import parallelism
from ..session import materialize
from . import inputs as I
from .registry import query
from .sql import PICK, with_

THRESHOLD = "50"


def _text(df, *cols):
    return df.select(joined("pattern").alias("pattern"), *cols)


def written(baskets):
    """Baskets written once, in as many parts as their subsets need."""
    return materialize(baskets.repartition(parallelism(baskets.sparkSession)))


def frequent(spark, sf):
    return P.frequent_patterns(P.net_baskets(I.basket_ids(spark, sf)), I.pattern_threshold(spark, sf))


@query("dict_build", with_("SELECT word, id FROM dict", "dict"))
def dict_build(spark, sf):
    return I.dictionary(spark, sf)


@query("dict_lines", """SELECT p_type AS word, CAST(max(r) AS INTEGER) AS id FROM (
  SELECT p_type, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part) GROUP BY 1""")
def dict_lines(spark, sf):
    lines = I.table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_type").alias("word"))
    return P.dictionary_from_lines(lines)


@query("join_dict", with_("SELECT seq, word, id FROM bw JOIN dict USING (word)", "bw", "dict"))
def join_dict(spark, sf):
    return P.join_dictionary(I.basket_adds(spark, sf), I.dictionary(spark, sf), ["seq"])


@query("basket_ids", with_("""SELECT seq, true AS is_add, array_to_string(ids, ',') AS ids FROM adds
  UNION ALL SELECT seq, false, array_to_string(ids, ',') FROM adds WHERE seq % 5 = 0""", "adds"))
def basket_ids(spark, sf):
    return I.basket_ids(spark, sf).select("seq", "is_add", joined("ids").alias("ids"))


SUBSETS = "SELECT seq, array_to_string({0}, ',') AS pattern FROM (SELECT seq, ids, unnest(generate_series(1, (1 << len(ids)) - {1})) AS m FROM adds)"


@query("subsets_all", with_(SUBSETS.format(PICK, 1), "adds"))
def subsets_all(spark, sf):
    return _text(P.expand_subsets(written(I.add_ids(spark, sf)), "ids", ["seq"]), "seq")


@query("subsets_proper", with_(SUBSETS.format(PICK, 2), "adds"))
def subsets_proper(spark, sf):
    return _text(P.expand_subsets(written(I.add_ids(spark, sf)), "ids", ["seq"], proper=True), "seq")


@query("pattern_count", with_("SELECT array_to_string(pattern, ',') AS pattern, cnt FROM pc WHERE cnt > 0", "pc"))
def pattern_count(spark, sf):
    return _text(P.pattern_counts(P.net_baskets(I.basket_ids(spark, sf))), "cnt")


@query("pattern_count_clamped", with_(f"""SELECT array_to_string(pattern, ',') AS pattern, CAST(total - least(0, low) AS BIGINT) AS cnt FROM (
  SELECT pattern, sum(step) AS total, min(s) AS low FROM (
    SELECT pattern, step, sum(step) OVER (PARTITION BY pattern ORDER BY arrival) AS s FROM (
      SELECT arrival, step, {PICK} AS pattern FROM (SELECT arrival, step, ids, unnest(generate_series(1, (1 << len(ids)) - 1)) AS m FROM (
        SELECT seq * 2 + 1 AS arrival, 1 AS step, ids FROM adds UNION ALL SELECT seq * 2 - seq % 2 * 40, -1, ids FROM adds WHERE seq % 5 = 0))))
  GROUP BY pattern) WHERE total - least(0, low) > 0""", "adds"))
def pattern_count_clamped(spark, sf):
    # Removals of odd orders arrive up to 20 orders late, those of even orders just before the addition.
    b = I.basket_ids(spark, sf)
    late = F.col("seq") * 2 - F.col("seq") % 2 * 40
    arrivals = b.withColumn("arrival", F.when(F.col("is_add"), F.col("seq") * 2 + 1).otherwise(late))
    return _text(P.clamped_pattern_counts(arrivals, "arrival"), "cnt")


@query("pattern_frequent", with_("SELECT array_to_string(pattern, ',') AS pattern, cnt FROM freq", "freq"))
def pattern_frequent(spark, sf):
    return _text(frequent(spark, sf), "cnt")


@query("pattern_maximal", with_("SELECT array_to_string(pattern, ',') AS pattern, cnt FROM maxi", "maxi"))
def pattern_maximal(spark, sf):
    return _text(P.maximal_patterns(frequent(spark, sf)), "cnt")


@query("pattern_refcount", with_("""SELECT array_to_string(f.pattern, ',') AS pattern, f.cnt, count(g.pattern) AS ref_count FROM freq f LEFT JOIN freq g
  ON len(g.pattern) > len(f.pattern) AND list_has_all(g.pattern, f.pattern) GROUP BY ALL""", "freq"))
def pattern_refcount(spark, sf):
    return _text(P.reference_counts(frequent(spark, sf)), "cnt", "ref_count")


@query("pattern_changelog", with_("""SELECT array_to_string(coalesce(a.pattern, b.pattern), ',') AS pattern, a.pattern IS NOT NULL AS is_maximal, coalesce(a.cnt, 0) AS cnt
  FROM maxi a FULL OUTER JOIN maxi_add b ON a.pattern = b.pattern WHERE (a.pattern IS NULL) <> (b.pattern IS NULL)""", "maxi", "maxi_add"))
def pattern_changelog(spark, sf):
    """Changes caused by the removals after all additions were counted."""
    t = I.pattern_threshold(spark, sf)
    folded = materialize(P.folded_baskets(I.basket_ids(spark, sf)))
    before = P.maximal_patterns(P.frequent_patterns(P.net_baskets(folded.where("is_add"), "rows"), t))
    after = P.maximal_patterns(P.frequent_patterns(P.net_baskets(folded, "rows"), t))
    return _text(P.maximal_changes(before, after), "is_maximal", "cnt")


@query("pattern_words", with_("""SELECT array_to_string(pattern, ',') AS pattern, cnt, (SELECT string_agg(word, ' ' ORDER BY id) FROM dict WHERE list_contains(pattern, id)) AS words
  FROM maxi""", "maxi", "dict"))
def pattern_words(spark, sf):
    named = P.pattern_words(P.maximal_patterns(frequent(spark, sf)), I.dictionary(spark, sf))
    return _text(named, "cnt", F.array_join("words", " ").alias("words"))


# --- outliers ---------------------------------------------------------------

DISTANCE, MIN_NEIGHBORS, PROJECTIONS = 0.02, 5, 8


def projected(spark, sf):
    return O.project_vectors(I.objects(spark, sf), O.walsh_rows(PROJECTIONS, 64))


@query("project_vectors", with_("SELECT id, CAST(projection_id AS INTEGER) AS projection_id, round(pv, 9) AS projection_value FROM proj", "proj"))
def project_vectors(spark, sf):
    return projected(spark, sf).select("id", "projection_id", F.round("projection_value", 9).alias("projection_value"))


@query("neighbor_count", with_("SELECT CAST(projection_id AS INTEGER) AS projection_id, id, neighbors FROM neigh", "neigh"))
def neighbor_count(spark, sf):
    return O.neighbor_counts(projected(spark, sf), DISTANCE).select("projection_id", "id", "neighbors")


@query("outlier_snapshot", with_("SELECT CAST(projection_id AS INTEGER) AS projection_id, id, neighbors, neighbors < 5 AS is_outlier FROM neigh", "neigh"))
def outlier_snapshot(spark, sf):
    last = O.latest_objects(I.objects(spark, sf))
    p = O.project_vectors(last, O.walsh_rows(PROJECTIONS, 64))
    return O.outlier_snapshot(p, DISTANCE, MIN_NEIGHBORS).select("projection_id", "id", "neighbors", "is_outlier")


@query("outlier_merge", with_("SELECT id, bool_or(neighbors < 5) AS is_outlier FROM neigh GROUP BY id", "neigh"))
def outlier_merge(spark, sf):
    flags = O.outlier_snapshot(projected(spark, sf), DISTANCE, MIN_NEIGHBORS)
    return O.outlier_merge(flags, PROJECTIONS, ["time", "id"]).select("id", "is_outlier")


def moving(objects, count):
    """Rows of the table as arrivals of a fifth as many objects, each with five places in turn."""
    return objects.withColumn("id", F.col("seq") % F.lit(max(1, count // 5)))


@query("outlier_per_arrival", with_("""SELECT seq, CAST(projection_id AS INTEGER) AS projection_id, obj_id, is_outlier FROM (
  SELECT *, lag(is_outlier) OVER (PARTITION BY projection_id, obj_id ORDER BY seq) AS was FROM (
    SELECT a.seq, a.projection_id, a.obj_id, count(*) FILTER (WHERE a.obj_id <> b.obj_id AND abs(a.v - b.v) <= 0.05) < 5 AS is_outlier
    FROM st a JOIN st b ON a.seq = b.seq AND a.projection_id = b.projection_id GROUP BY ALL) JOIN complete USING (projection_id) WHERE seq >= complete)
  WHERE was IS NULL OR was <> is_outlier""", "proj").replace("\nSELECT seq, CAST(projection_id", """,
obs AS (SELECT seq, seq % (SELECT greatest(1, count(*) // 5) FROM embeddings) AS id, projection_id, pv FROM proj),
complete AS (SELECT projection_id, max(seq) AS complete FROM (SELECT projection_id, id, min(seq) AS seq FROM obs GROUP BY ALL) GROUP BY 1),
st AS (SELECT * FROM (SELECT o.seq, o.projection_id, i AS obj_id, last_value(CASE WHEN o.id = i THEN o.pv END IGNORE NULLS) OVER (
  PARTITION BY o.projection_id, i ORDER BY o.seq) AS v FROM obs o, (SELECT DISTINCT id AS i FROM obs)) WHERE v IS NOT NULL)
SELECT seq, CAST(projection_id""", 1))
def outlier_per_arrival(spark, sf):
    """All projections and all objects: the flags once every object is known, then each flag that flips."""
    objects = I.objects(spark, sf)
    p = O.project_vectors(moving(objects, objects.count()), O.walsh_rows(PROJECTIONS, 64), ["seq", "id"])
    return X.since_complete(materialize(X.outlier_flips(p, 0.05, MIN_NEIGHBORS)))
