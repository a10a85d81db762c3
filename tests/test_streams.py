"""Streams: levels of change folders, restarts at any point, late events, what a batch writes."""

import os

import pytest
from pyspark.sql import functions as F

from namemine.operators import feedback
from namemine.streaming import folders, jobs

EVENT = "ts long, event_id long, element string, action string, value double"


def change(spark, number):
    return spark.createDataFrame([("k%d" % (number % 3), 1), ("all", number)], "key string, cnt long").coalesce(1)


def totals(spark, root, fanout):
    schema = change(spark, 0).schema
    return {r["key"]: r["cnt"] for r in folders.read_folders(spark, root, schema, jobs.merge_counts, fanout).collect()}


def plain(n):
    out = {"k%d" % i: len(range(i, n, 3)) for i in range(3)}
    return {k: v for k, v in (out | {"all": n * (n - 1) // 2}).items() if v}


def test_a_thousand_batches_are_read_from_few_folders():
    for n in (1, 15, 16, 17, 255, 256, 1000, 4096, 5000):
        complete = {(0, i) for i in range(n)} | {(lv, i) for lv in (1, 2, 3) for i in range(n // 16**lv)}
        live = folders.live_folders(complete)
        held = sorted(b for lv, i in live for b in range(i * 16**lv, (i + 1) * 16**lv))
        assert held == list(range(n)) and len(live) <= 15 * 4


def test_batches_merge_in_levels_and_survive_any_end(spark, tmp_path, monkeypatch):
    root, merge = str(tmp_path / "t"), jobs.merge_counts
    merged = folders._merge_level
    for n in range(29):
        if n in (8, 17):  # the run dies before, or halfway through, a merge, and the stream runs the batch again
            def dies(spark, root, level, this, *rest):
                if n == 17 and level == 1:
                    return merged(spark, root, level, this, *rest)
                os.makedirs(f"{root}/{folders._name(level, this)}")
                raise OSError("lost")

            monkeypatch.setattr(folders, "_merge_level", dies)
            with pytest.raises(OSError):
                folders.add_batch(change(spark, n), n, root, merge, 3)
            monkeypatch.setattr(folders, "_merge_level", merged)
            assert totals(spark, root, 3) == plain(n + 1)
        folders.add_batch(change(spark, n), n, root, merge, 3)
        if n in (2, 5, 8, 9, 17, 26, 28):
            folders.add_batch(change(spark, n), n, root, merge, 3)  # run twice: written before the stream's own commit
            assert totals(spark, root, 3) == plain(n + 1)
    live = folders.live_folders(folders.complete_folders(spark, root), 3)
    assert live == [(0, 27), (0, 28), (3, 0)]
    assert len(os.listdir(root)) < 29


def write(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def test_state_of_a_stream_with_late_events(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "out")
    rows = []

    def add(*new):
        rows.extend(new)
        write(spark, log, list(new))

    def check():
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(log)
        got = jobs.stream_latest_state(stream, root)
        want = feedback.latest_state(spark.createDataFrame(rows, EVENT))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        return {r["element"]: tuple(r)[1:] for r in got.collect()}

    add((10, 1, "a", "put", 1.0), (11, 2, "a", "ignore", None), (10, 3, "b", "put", 5.0))
    assert check() == {"a": (1.0, False, True), "b": (5.0, False, False)}
    add((5, 4, "a", "put", 9.0), (12, 5, "c", "recalculate", None))  # late: the later put stays
    assert check()["a"] == (1.0, False, True)
    add((20, 6, "a", "put", 2.0))
    write(spark, log, [])  # an empty batch
    add((21, 7, "a", "recalculate", None), (22, 8, "c", "put", None))
    assert check() == {"a": (2.0, True, False), "b": (5.0, False, False), "c": (None, False, False)}
    assert check()["a"] == (2.0, True, False)  # nothing new
    sizes = {n: spark.read.parquet(f"{root}/changes/L0-{n}").count() for n in range(5)}
    assert sorted(sizes.values()) == [0, 1, 2, 2, 2]  # a row for each element of the batch's events


def test_rename_scores_of_a_stream(spark, tmp_path):
    schema = "ts long, action string, value array<double>"
    log = str(tmp_path / "log")
    rows = [(1, "applied", [0.5]), (2, "ignored", [0.1, 0.2, 0.1]), (3, "view", [9.0]), (4, "ignored", []), (5, "applied", [0.5])]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(log)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log)
    got = jobs.stream_rename_stats(stream, str(tmp_path / "out"))
    assert {tuple(r) for r in got.collect()} == {("applied", 0.5, 2), ("ignored", 0.1, 2), ("ignored", 0.2, 1)}
    want = feedback.rename_stats(spark.createDataFrame(rows, schema).where(F.col("ts") > 0))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
