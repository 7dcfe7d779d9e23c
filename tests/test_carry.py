"""Reports carried forward as a stream: equal to the batch form, over restarts, with silent and late keys."""

import random

from pyspark.sql import functions as F

from weir.operators import telemetry as M
from weir.streaming.carry import carry_forward
from weir.streaming.runs import drain_to_parquet, parquet_stream

DAY = 86_400_000
SCHEMA = "task int, name string, cycle bigint, n bigint, x double, m map<string,string>"


def report(task, day, rnd):
    return (task, None if task == 3 else f"t{task}", day * DAY, None if day % 4 == 0 else rnd.randrange(1 << 60), rnd.random(), {"k": f"a,{day}"})


def append(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(folder)


def drained(spark, tmp_path):
    stream = carry_forward(parquet_stream(spark, f"{tmp_path}/in", "*.parquet"), ["task", "name"])
    return drain_to_parquet(stream, "carry", f"{tmp_path}/run")


def test_equals_the_batch_form_over_restarts(spark, tmp_path):
    rnd = random.Random(1)
    # Task 0 reports daily, the others now and then; task 5 falls silent for good, task 6 starts late.
    days = {t: [d for d in range(100, 120) if t == 0 or (rnd.random() < 0.4 and not (t == 5 and d > 106) and not (t == 6 and d < 109))] for t in range(7)}
    rows = [report(t, d, rnd) for t, ds in days.items() for d in ds]
    for low, high in ((100, 107), (107, 108), (108, 120)):
        append(spark, f"{tmp_path}/in", [r for r in rows if low * DAY <= r[2] < high * DAY])
        got = drained(spark, tmp_path)
        # The newest cycle is still open.
        assert got.agg(F.max("cycle")).first()[0] == (high - 2) * DAY
    append(spark, f"{tmp_path}/in", [(8, "t8", 119 * DAY, 1, 1.0, {})])  # the newest day in one more batch
    rows.append((8, "t8", 119 * DAY, 1, 1.0, {}))
    drained(spark, tmp_path)
    append(spark, f"{tmp_path}/in", [(0, "t0", 120 * DAY, 1, 1.0, {})])
    want = M.snapshot_ffill(spark.createDataFrame(rows, SCHEMA), ["task", "name"])
    text = lambda df: sorted(str((r["task"], r["name"], r["cycle"], r["reported_cycle"], r["n"], r["x"], r["m"])) for r in df.collect())
    assert text(drained(spark, tmp_path)) == text(want)


def test_order_within_the_delay_and_late_reports(spark, tmp_path):
    folder = f"{tmp_path}/in"

    def run():
        return drain_to_parquet(carry_forward(parquet_stream(spark, folder, "*.parquet"), ["task"], delay="2 days"), "carry", f"{tmp_path}/run")

    one = lambda task, day, n: (task, "a", None if day is None else day * DAY, n, 0.0, None)
    append(spark, folder, [one(1, 11, 11), one(1, None, 0)])
    run()
    append(spark, folder, [one(1, 10, 10), one(1, 10, 9), one(1, 12, 12)])  # day 10 comes after day 11, in time
    run()
    append(spark, folder, [one(2, 15, 1)])
    run()
    append(spark, folder, [one(1, 11, 99)])  # day 11 went out already
    got = [(r["task"], r["cycle"] // DAY, r["reported_cycle"] // DAY, r["n"]) for r in run().orderBy("task", "cycle").collect()]
    assert got == [(1, 10, 10, 9), (1, 11, 11, 11), (1, 12, 12, 12)]
