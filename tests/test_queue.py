"""Queue with offsets: dense over appends, ranges open their segments only, streams replay failed batches."""

import pytest
from pyspark.sql import functions as F

from weir.sources.queue import Queue
from weir.streaming.runs import drain_all_to_parquet, drain_batches


def filled(spark, folder, parts=((0, 250), (250, 600))):
    queue = Queue(spark, str(folder), spark.createDataFrame([], "key bigint, text string").schema, size=100)
    for low, high in parts:
        # Keys fall while offsets of the part rise.
        queue.append(spark.range(low, high).select((-F.col("id")).alias("key"), F.concat(F.lit("row "), "id").alias("text")), ["key"])
    return queue


def test_offsets_are_dense_over_appends(spark, tmp_path):
    queue = filled(spark, tmp_path / "q")
    got = [(r["offset"], r["key"]) for r in queue.rows().orderBy("offset").collect()]
    assert got == list(enumerate([*range(-249, 1), *range(-599, -249)]))
    assert queue.end() == 600


def test_a_range_opens_its_segments_only(spark, tmp_path):
    queue = filled(spark, tmp_path / "q")
    offsets = lambda start, n: sorted(r["offset"] for r in queue.scan(start, n).collect())
    assert offsets(195, 10) == list(range(195, 205))
    assert offsets(595, 100) == [595, 596, 597, 598, 599] and offsets(600, 10) == [] and offsets(10, 0) == []
    # Every other segment is spoilt: a scan that opened one would fail.
    for file in (tmp_path / "q").glob("segment=*/*.parquet"):
        if file.parent.name != "segment=3":
            file.write_bytes(b"no parquet")
    assert offsets(310, 80) == list(range(310, 390))
    with pytest.raises(Exception):
        offsets(390, 20)


def test_empty_queue_and_clashing_names(spark, tmp_path):
    queue = filled(spark, tmp_path / "q", ())
    assert queue.end() == 0 and queue.rows().count() == 0 and queue.scan(0, 5).columns == ["offset", "key", "text"]
    queue.append(spark.createDataFrame([], "key bigint, text string"), ["key"])
    assert queue.end() == 0
    with pytest.raises(ValueError):
        Queue(spark, str(tmp_path / "r"), spark.createDataFrame([], "Offset bigint").schema)


def test_stream_admits_by_count_and_replays_a_failed_batch(spark, tmp_path):
    queue, seen = filled(spark, tmp_path / "q"), {}

    def write(fail):
        def run(batch, batch_id):
            if batch_id == fail:
                raise RuntimeError("lost")
            seen[batch_id] = sorted(r["offset"] for r in batch.select("offset").collect())
        return run

    with pytest.raises(Exception, match="lost"):
        drain_batches(queue.stream(200), write(2), str(tmp_path / "run"), "append")
    first = dict(seen)
    assert sorted(first) == [0, 1]
    drain_batches(queue.stream(200), write(None), str(tmp_path / "run"), "append")
    assert {k: seen[k] for k in first} == first
    assert sorted(o for batch in seen.values() for o in batch) == list(range(600))
    assert all(len(batch) <= 200 for batch in seen.values())
    queue.append(spark.createDataFrame([(7, "late")], "key bigint, text string"), ["key"])
    drain_batches(queue.stream(200), write(None), str(tmp_path / "run"), "append")
    assert seen[max(seen)] == [600]


def test_consumers_share_all_segments_with_batches_of_their_own(spark, tmp_path):
    queue = filled(spark, tmp_path / "q", ((0, 250), (250, 1250)))
    for consumers in (2, 5, 10):
        taken = {}
        for k, stream in enumerate(queue.streams(200, consumers)):
            def write(batch, batch_id):
                taken[k, batch_id] = [r["offset"] for r in batch.select("offset").collect()]

            drain_batches(stream, write, str(tmp_path / f"run-{consumers}-{k}"), "append")
        assert sorted(o for offsets in taken.values() for o in offsets) == list(range(1250))
        # Segment 2 has a file of each append, so a batch has two files, of this consumer's segments.
        assert all(len(offsets) <= 200 and {o // 100 % consumers for o in offsets} == {k} for (k, _), offsets in taken.items())
        assert len({k for k, _ in taken}) == consumers
    for wrong in ((0, 3), (2, 2), (-1, 2)):
        with pytest.raises(ValueError):
            queue.stream(200, *wrong)


def test_consumers_run_side_by_side_and_continue(spark, tmp_path):
    # Three segments of ten consumers have rows; the others end with none.
    queue, folder = filled(spark, tmp_path / "q", ((0, 250),)), str(tmp_path / "run")
    offsets = lambda: sorted(r["offset"] for r in drain_all_to_parquet(queue.streams(200, 10), "queue", folder).collect())
    assert offsets() == list(range(250))
    queue.append(spark.range(1000).select((-F.col("id")).alias("key"), F.lit("late").alias("text")), ["key"])
    assert offsets() == list(range(1250))


def test_a_failed_consumer_stops_the_others(spark, tmp_path):
    queue = filled(spark, tmp_path / "q")
    for file in (tmp_path / "q" / "segment=3").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    with pytest.raises(Exception):
        drain_all_to_parquet(queue.streams(200, 5), "queue", str(tmp_path / "run"))
    assert not spark.streams.active


def test_an_empty_queue_has_no_rows_for_any_consumer(spark, tmp_path):
    queue = filled(spark, tmp_path / "q", ())
    queue.append(spark.createDataFrame([], "key bigint, text string"), ["key"])
    assert drain_all_to_parquet(queue.streams(200, 2), "queue", str(tmp_path / "run")).collect() == []
