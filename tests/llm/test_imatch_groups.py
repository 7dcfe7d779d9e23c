"""Groups so large that their terms leave the lexicon, tables too small for one."""

import random

from pyspark.sql import functions as F

from weir.llm import imatch

from .test_llm import docs


def test_edited_copies_of_a_third_stay_alike(spark):
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    group = []
    for i in range(60):
        words = list(base)
        words[rnd.randrange(80)] = f"e{i}"
        group.append((i, " ".join(words), "a"))
    others = [(1000 + i, " ".join(f"w{rnd.randrange(600)}" for _ in range(60)), "a") for i in range(120)]
    got = {r["doc_id"]: r for r in imatch.edited(docs(spark, group + others)).collect()}
    # Document 0 is followed by the last of the others, whose head has terms of the lexicon.
    near = [(got[i]["near_edited"], got[i]["near_next"]) for i in range(1, 60)]
    assert min(near)[0] > 0.2 and min(n for _, n in near) > 0.6, near
    assert got[1000]["near_next"] < 0.2


def test_small_table_and_copies(spark):
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(40)), "a") for i in range(5)]
    edited = rows[0][1].replace("t0x3 ", "new ")
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(docs(spark, rows + [(9, edited, "a")])).collect()}
    alike = spark.createDataFrame([(got[0], got[9]), (got[0], got[1])], "a string, b string").select(imatch.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert alike[0]["x"] > 0.7 and alike[1]["x"] == 0
    copies = [(i, "same words here", "a") for i in range(400)] + [(1000 + i, f"u{i} u{i + 1}", "a") for i in range(99)]
    kept = imatch.weighed(imatch.keyed(docs(spark, copies))).where("tier = 0").count()
    assert kept == 100 + 3
