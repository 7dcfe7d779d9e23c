"""Sources and text queries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import text as X
from ..sources import records as R
from ..streaming import text as ST
from ..streaming.runs import parquet_stream
from . import inputs as I
from .registry import query
from .sql import clean, tokens, with_


@query("src_text", with_("SELECT seq, text FROM queue", "queue"))
def src_text(spark, sf):
    return ST.queue_rows(I.queue_columns(parquet_stream(spark, sf, "events.parquet")).select("seq", "text"))


@query("parse_signed", with_("SELECT seq, substr(text, 2) AS sentence, text LIKE '+%' AS is_add FROM queue", "queue"))
def parse_signed(spark, sf):
    return R.parse_signed(I.queue(spark, sf).select("seq", "text"))


@query("parse_object", with_("""SELECT seq, seq % 200 AS id, seq AS time, CAST(len(v) AS BIGINT) AS dim, round(list_sum(v), 6) AS vsum,
  round(v[1], 6) AS first_v FROM objects""", "objects"))
def parse_object(spark, sf):
    o = R.parse_object(I.object_lines(spark, sf), 200)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return o.select("seq", "id", "time", F.size("vector").cast("bigint").alias("dim"), F.round(total, 6).alias("vsum"), F.round(F.col("vector")[0], 6).alias("first_v"))


@query("encode_records", with_("SELECT seq, seq || '|' || time || '|' || text AS record, '+' || text AS addition FROM queue", "queue"))
def encode_records(spark, sf):
    q = I.queue(spark, sf)
    return q.select("seq", R.encode_record(F.col("seq"), F.col("time"), F.col("text")).alias("record"), R.encode_addition(F.col("text")).alias("addition"))


@query("scan_range", with_("SELECT seq, text FROM queue WHERE seq >= 100 AND seq < 100 + 5000", "queue"))
def scan_range(spark, sf):
    return R.scan_range(I.queue(spark, sf).select("seq", "text"), 100, 5000)


@query("batch_by_count", with_("""SELECT CAST((row_number() OVER (ORDER BY seq) - 1) // 700 AS BIGINT) AS batch, seq, value FROM queue
  """, "queue"))
def batch_by_count(spark, sf):
    return R.batch_by_count(I.queue(spark, sf).select("seq", "value"), 700)


@query("batch_by_time", """SELECT (epoch_us(ts) // 1000) // 3600000 * 3600000 AS batch_start, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def batch_by_time(spark, sf):
    b = R.batch_by_time(I.marks(spark, sf), 3_600_000)
    return b.groupBy("batch_start").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("value"), 4).alias("total"))


@query("parse_numeric_lines", "SELECT event_id AS seq, value AS w FROM events WHERE event_id % 50 <> 0")
def parse_numeric_lines(spark, sf):
    return R.parse_numeric_lines(I.number_lines(spark, sf))


@query("tokenize", with_("SELECT seq, CAST(pos AS BIGINT) AS pos, word FROM tok", "tok"))
def tokenize(spark, sf):
    t = X.tokenize(I.sentences(spark, sf), "sentence", ["seq"])
    return t.withColumn("pos", F.col("pos").cast("bigint"))


@query("tokenize_charset", with_(r"""SELECT seq, CAST(unnest(range(0, len(ws))) AS BIGINT) AS pos, unnest(ws) AS word FROM (
  SELECT seq, list_filter(string_split_regex(sentence, '[\\s+]'), lambda x: x <> '') AS ws FROM sentences)""".replace(r"[\\s+]", r"[\x5Cs+]"), "sentences"))
def tokenize_charset(spark, sf):
    t = X.tokenize_charset(I.sentences(spark, sf), "sentence", ["seq"])
    return t.withColumn("pos", F.col("pos").cast("bigint"))


@query("basket_words", with_(f"SELECT seq, array_to_string(list_sort(list_distinct({tokens(clean('sentence'))})), ' ') AS words FROM sentences", "sentences"))
def basket_words(spark, sf):
    b = X.basket_words(I.sentences(spark, sf), "sentence", ["seq"])
    return b.select("seq", F.array_join(F.array_sort("words"), " ").alias("words"))


@query("suffix_word", with_("SELECT seq, CAST(pos AS BIGINT) AS pos, word || '!!' AS word FROM tok", "tok"))
def suffix_word(spark, sf):
    t = X.tokenize(I.sentences(spark, sf), "sentence", ["seq"])
    return t.select("seq", F.col("pos").cast("bigint").alias("pos"), T.suffixed("word").alias("word"))


@query("make_sid", with_("SELECT seq, 's-' || seq % 4 || '-' || seq // 4 AS sid FROM sentences", "sentences"))
def make_sid(spark, sf):
    seq = F.col("seq")
    return I.sentences(spark, sf).select("seq", T.row_sid("s", seq % 4, F.expr("seq div 4")).alias("sid"))


ROUTED = "CASE WHEN ((seq % 1000003) * 7919 + 104729) % 10000 / 10000.0 < 0.3 THEN 'first' ELSE 'second' END"


@query("route_split", with_(f"SELECT seq, {ROUTED} AS stream FROM sentences", "sentences"))
def route_split(spark, sf):
    fraction = ((F.col("seq") % 1000003) * 7919 + 104729) % 10000 / 10000.0
    return X.route(I.sentences(spark, sf), ["seq"], 0.3, fraction).select("seq", "stream")


@query("stream_union", with_("""SELECT 'documents' AS stream, seq, length(sentence) AS n FROM sentences
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, length(text) FROM conversations""", "sentences"))
def stream_union(spark, sf):
    talk = I.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("text").alias("sentence"))
    both = X.union_streams({"documents": I.sentences(spark, sf), "conversations": talk})
    return both.select("stream", "seq", F.length("sentence").cast("bigint").alias("n"))


@query("repartition_by_key", "SELECT doc_id, lang, source FROM documents")
def repartition_by_key(spark, sf):
    # Few languages, one of them hot: the salt keeps all tasks busy.
    d = I.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return X.repartition_by_key(d, ["lang"], salt=F.pmod("doc_id", F.lit(64)))


@query("word_count", with_("SELECT word, cnt FROM wc", "wc"))
def word_count(spark, sf):
    return X.word_count(X.tokenize(I.sentences(spark, sf), "sentence"))


@query("word_count_stream", with_("SELECT word, cnt FROM wc", "wc"))
def word_count_stream(spark, sf):
    return ST.word_count(parquet_stream(spark, sf, "documents.parquet"), "text")


@query("word_running_count", with_("""SELECT seq, CAST(pos AS BIGINT) AS pos, word, row_number() OVER (PARTITION BY word ORDER BY seq, pos) AS cnt
  FROM tok""", "tok"))
def word_running_count(spark, sf):
    t = X.running_count(X.tokenize(I.sentences(spark, sf), "sentence", ["seq"]), ["seq", "pos"])
    return t.select("seq", F.col("pos").cast("bigint").alias("pos"), "word", "cnt")


@query("top_keywords", with_(f"""SELECT w AS word, CASE WHEN w IN (SELECT word FROM stop) THEN 0 ELSE c END AS cnt FROM (
  SELECT lower(x) AS w, count(*) AS c FROM (SELECT unnest({tokens(clean('sentence'))}) AS x FROM sentences) GROUP BY 1)
  ORDER BY cnt DESC, word LIMIT 50""", "sentences", "stop"))
def top_keywords(spark, sf):
    return X.top_keywords(I.sentences(spark, sf), "sentence", I.stop_words(spark, sf), 50)


@query("top_entries", with_("SELECT word, cnt FROM wc ORDER BY cnt DESC, word LIMIT 4", "wc"))
def top_entries(spark, sf):
    return X.top_entries(word_count(spark, sf), "word", "cnt", 4)


@query("f_factorial", """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS n,
  CASE WHEN l_quantity <= 20 THEN CAST(factorial(CAST(least(l_quantity, 20) AS INTEGER)) AS BIGINT) END AS f FROM lineitem""")
def f_factorial(spark, sf):
    from ..functions.queueing import factorial

    n = F.col("l_quantity").cast("int")
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n.alias("n"), factorial(n).alias("f"))
