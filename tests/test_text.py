from pyspark.sql import functions as F

from weir.operators import text as X
from weir.sources import records as R

# Sample sentences.
SENTENCES = [
    "the cow jumped over the moon",
    "the man went to the store and bought some candy",
    "four score and seven years ago",
    "how many apples can you eat",
]


def sentences(spark):
    return spark.createDataFrame(list(enumerate(SENTENCES)), "seq bigint, sentence string")


def test_charset_tokens(spark):
    t = X.tokenize_charset(sentences(spark).where("seq = 1"), "sentence", ["seq"])
    assert [r.word for r in t.orderBy("pos").collect()] == ["the man went to the ", "tore and bought ", "ome candy"]


def test_running_count_over_block_borders(spark):
    t = X.tokenize(sentences(spark), "sentence", ["seq"])
    for width in (1, 2, 100):
        got = X.running_count(t, ["seq", "pos"], width=width).where("word = 'the'").orderBy("seq", "pos")
        assert [r.cnt for r in got.collect()] == [1, 2, 3, 4]


def test_top_keywords_zeroes_stop_words(spark):
    texts = spark.createDataFrame([("The cat, the dog! THE end. cat",)], "t string")
    stop = spark.createDataFrame([(" the ",), ("absent",), ("",)], "word string")
    got = [(r.word, r.cnt) for r in X.top_keywords(texts, "t", stop, 10).collect()]
    assert got == [("cat", 2), ("dog", 1), ("end", 1), ("the", 0)]


def test_top_entries(spark):
    rows = [("Tom", 10), ("John", 13), ("Jack", 5), ("Jack1", 45), ("Jack2", 35), ("Jack3", 25), ("Jack4", 15)]
    top = X.top_entries(spark.createDataFrame(rows, "k string, v int"), "k", "v", 4)
    assert [r.k for r in top.collect()] == ["Jack1", "Jack2", "Jack3", "Jack4"]


def test_route_is_stable_and_complete(spark):
    df = spark.range(10_000)
    first, second = X.split_streams(X.route(df, ["id"], 0.3))
    n = first.count()
    assert n + second.count() == 10_000 and 2_700 < n < 3_300
    assert first.join(X.split_streams(X.route(df, ["id"], 0.3))[0], "id").count() == n


def test_batches(spark):
    df = spark.createDataFrame([(i * 3,) for i in range(23)], "seq bigint")
    sizes = R.batch_by_count(df, 10).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes] == [10, 10, 3]
    ten = spark.range(10).select((F.col("id") * 200).alias("time"))
    assert {r.batch_start: r["count"] for r in R.batch_by_time(ten, 1000).groupBy("batch_start").count().collect()} == {0: 5, 1000: 5}


def test_parse_signed_and_object(spark):
    r = R.parse_signed(spark.createDataFrame([("+a b",), ("-c",)], "text string")).collect()
    assert [(x.sentence, x.is_add) for x in r] == [("a b", True), ("c", False)]
    o = R.parse_object(spark.createDataFrame([("1003|77|0.5,1.5",)], "text string"), 1000).first()
    assert (o.seq, o.id, o.time, o.vector) == (1003, 3, 77, [0.5, 1.5])


def test_text_files_round_trip(spark, tmp_path):
    sentences(spark).select("sentence").write.text(str(tmp_path / "q"))
    assert sorted(r.text for r in R.read_text(spark, str(tmp_path / "q")).collect()) == sorted(SENTENCES)


def test_numeric_and_transition_lines(spark):
    n = R.parse_numeric_lines(spark.createDataFrame([(" 1.5 ",), ("  ",), ("2",)], "text string"))
    assert sorted(r.w for r in n.collect()) == [1.5, 2.0]
    ok = spark.createDataFrame([("1:2:0.5",), ("2:1:0.25",)], "text string")
    assert R.parse_transitions(ok).count() == 2
    twice = spark.createDataFrame([("1:2:0.5",), ("1:2:0.25",)], "text string")
    try:
        R.parse_transitions(twice).collect()
    except Exception as e:
        assert "repeated transition 1 2" in str(e)
    else:
        raise AssertionError("a repeated pair must fail")


def test_bad_lines_are_set_aside(spark):
    lines = spark.createDataFrame([("1.5",), ("abc",), ("",), (None,), ("a:b:0.5",), ("a:c:x",), ("a:b",)], "text string")
    assert [r.w for r in R.parse_numeric_lines(lines).collect()] == [1.5]
    assert sorted(r.text for r in R.bad_numeric_lines(lines).collect()) == ["a:b", "a:b:0.5", "a:c:x", "abc"]
    assert [tuple(r) for r in R.parse_transitions(lines).collect()] == [("a", "b", 0.5)]
    assert R.bad_transitions(lines).count() == 6


def test_running_count_moves_rows_once(spark):
    """Equal words over several blocks, null among them; no join with the blocks' counts."""
    rows = [(seq, pos, w) for seq in (-1, 0, 1, 2, 5, 6, 9) for pos, w in enumerate(["a", "b", "a", None])]
    got = X.running_count(spark.createDataFrame(rows, "seq bigint, pos int, word string"), ["seq", "pos"], width=2)
    seen, want = {}, []
    for seq, pos, w in rows:
        seen[w] = seen.get(w, 0) + 1
        want.append((seq, pos, w, seen[w]))
    assert got.columns == ["seq", "pos", "word", "cnt"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "Join" not in got._jdf.queryExecution().toString()
