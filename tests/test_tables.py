"""Tables that are replaced batch by batch: commits, replays, broken batches, history."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import tables

CHUNKS = "owner string, place int, chunk string"


def rows(spark, found):
    return sorted(map(tuple, found.collect()))


def chunks(owner, text):
    return [(owner, i, c) for i, c in enumerate(text.split())]


def test_replace_delete_replay(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(ValueError):
        tables.read(spark, folder)
    first = [c for o in "abcdef" for c in chunks(o, f"{o}1 {o}2 {o}3")]
    df = lambda data: spark.createDataFrame(data, CHUNKS)
    assert tables.rebuild(df([*first, (None, 0, "x")]), folder, 0, buckets=4)
    assert rows(spark, tables.read(spark, folder)) == sorted(first)
    second = chunks("a", "new") + chunks("z", "z1 z2") + chunks("b", "b1 b2 b3")
    gone = spark.createDataFrame([("c",), (None,), ("nobody",)], "o string")
    for _ in range(2):
        done = tables.replace(df(second), folder, 5, gone)
    assert not done
    wanted = sorted([r for r in first if r[0] in "def"] + second)
    assert rows(spark, tables.read(spark, folder)) == wanted
    assert rows(spark, tables.read(spark, folder, ["a", "c", "z"])) == [r for r in wanted if r[0] in "az"]
    assert not tables.replace(df(chunks("a", "late")), folder, 3)
    story = {(r.owner, r.batch): (r.change, r.rows_old, r.rows_new) for r in tables.history(spark, folder).collect()}
    assert {k: v for k, v in story.items() if k[1] == 5} == {("a", 5): ("CHANGED", 3, 1), ("b", 5): ("SAME", 3, 3), ("c", 5): ("REMOVED", 3, 0), ("z", 5): ("ADDED", 0, 2)}
    tables.vacuum(spark, folder)
    assert rows(spark, tables.read(spark, folder)) == wanted
    assert tables.rebuild(df(chunks("q", "q1")), folder, 6)
    assert rows(spark, tables.read(spark, folder)) == [("q", 0, "q1")]
    assert tables.rebuild(df([]), folder, 7)
    assert rows(spark, tables.read(spark, folder)) == []


def test_a_batch_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/t"
    df = lambda data: spark.createDataFrame(data, CHUNKS)
    tables.replace(df(chunks("a", "one two") + chunks("b", "three")), folder, 0, buckets=2)
    before, story = rows(spark, tables.read(spark, folder)), tables.history(spark, folder).count()

    def broken(*_):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(tables, "_commit", broken)
        with pytest.raises(RuntimeError):
            tables.replace(df(chunks("a", "half")), folder, 1)
    assert rows(spark, tables.read(spark, folder)) == before and tables.history(spark, folder).count() == story
    assert tables.replace(df(chunks("a", "whole again")), folder, 1)
    assert rows(spark, tables.read(spark, folder)) == sorted(chunks("a", "whole again") + chunks("b", "three"))
    assert tables.history(spark, folder).count() == story + 1


def test_upsert_takes_the_latest_row(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    df = lambda data: spark.createDataFrame(data, "id long, title string, at long")
    tables.upsert(df([(1, "a", 1), (2, "b", 1), (1, "c", 3), (1, "d", 2)]), folder, 0, "at", buckets=3)
    tables.upsert(df([(2, "e", 5), (3, "f", 5), (3, "f", 5)]), folder, 1, "at")
    assert rows(spark, tables.read(spark, folder)) == [(1, "c", 3), (2, "e", 5), (3, "f", 5)]
    assert tables.exists(spark, folder) and not tables.exists(spark, f"{folder}-none")


def test_stream_commits_once_for_each_batch(spark, tmp_path):
    folder, source = f"file://{tmp_path}/t", f"file://{tmp_path}/in"
    df = lambda data: spark.createDataFrame(data, CHUNKS)
    go = lambda: tables.stream(spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(source), folder, f"file://{tmp_path}/progress").awaitTermination()
    df(chunks("a", "one two")).coalesce(1).write.mode("append").parquet(source)
    go()
    df(chunks("a", "three") + chunks("b", "four")).coalesce(1).write.mode("append").parquet(source)
    go()
    go()
    assert rows(spark, tables.read(spark, folder)) == sorted(chunks("a", "three") + chunks("b", "four"))
    assert tables.committed(spark, folder) == [0, 1]
    assert tables.history(spark, folder).where(F.col("batch") == 1).count() == 2
