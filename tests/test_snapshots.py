"""Snapshots as trees of hashes."""

import random

import pytest

from tessera.operators import snapshots as S


def items(spark, data):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(t, i, p) for (t, i), p in data.items()], "type string, id string, payload string")
    return rows.withColumn("hash", F.sha2(F.coalesce("payload", F.lit("")), 256))


def plain_diff(a, b):
    return {(*k, "ADDED" if k not in a else "REMOVED" if k not in b else "MODIFIED") for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


def held(spark, folder, n):
    return {(r.type, r.id): r.payload for r in S.read(spark, folder, n).collect()}


def changes(found):
    return {(r.type, r.id, r.change) for r in found.collect()}


def test_snapshots_share_what_is_equal(spark, tmp_path):
    folder, rng = f"file://{tmp_path}/s", random.Random(1)
    first = {(rng.choice(["article", "file"]), f"k{i}"): f"text {i % 40}" for i in range(400)}
    second = dict(first)
    for k in rng.sample(sorted(first), 5):
        second[k] = "edited"
    for k in rng.sample(sorted(first), 3):
        second.pop(k, None)
    second["contribution", "new"] = "text 1"
    assert S.take(items(spark, first), folder) == 0
    assert S.take(items(spark, second), folder) == 1
    assert held(spark, folder, 0) == first and held(spark, folder, 1) == second
    assert changes(S.diff(spark, folder, 0, 1)) == plain_diff(first, second)
    assert changes(S.diff(spark, folder, 1, 0)) == plain_diff(second, first)
    assert S.diff(spark, folder, 1, 1).count() == 0
    # only the leaves of the change were written, each payload once, and a diff reads these leaves alone
    leaves = S.differing(S.tree(spark, folder, 0), S.tree(spark, folder, 1))
    assert 0 < len(leaves) <= 9
    assert len(list((tmp_path / "s/items/snapshot-1").glob("leaf=*"))) <= len(leaves)
    assert spark.read.parquet(f"{folder}/payloads/snapshot-0").count() == 40
    assert spark.read.parquet(f"{folder}/payloads/snapshot-1").count() == 1
    for part in (tmp_path / "s/items").glob("snapshot-*/leaf=*"):
        if part.name.split("=")[1] not in leaves:
            for file in part.iterdir():
                file.write_bytes(b"gone")
    assert changes(S.diff(spark, folder, 0, 1)) == plain_diff(first, second)


def test_rolling_back_and_names(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    first, second = {("a", "1"): "x", ("a", "2"): "y"}, {("a", "2"): "z", ("a", "3"): None}
    S.take(items(spark, first), folder)
    S.name(spark, folder, 0, "baseline")
    S.take(items(spark, second), folder)
    undo = {(r.id, r.action, r.payload) for r in S.undo(spark, folder, 0, 1).collect()}
    assert undo == {("1", "WRITE", "x"), ("2", "WRITE", "y"), ("3", "DELETE", None)}
    assert S.roll_back(spark, folder, S.named(spark, folder, "baseline")) == 2
    assert held(spark, folder, 2) == first and not (tmp_path / "s/items/snapshot-2").exists()
    assert S.take(items(spark, second), folder) == 3 and held(spark, folder, 3) == second
    assert S.take(items(spark, {("q", "q"): "q"}).limit(0), folder) == 4 and held(spark, folder, 4) == {}
    assert S.take(items(spark, first), folder) == 5 and held(spark, folder, 5) == first
    for call in (lambda: S.roll_back(spark, folder, 99), lambda: S.name(spark, folder, 99, "x")):
        with pytest.raises(ValueError):
            call()


def test_a_snapshot_that_breaks_off_is_not_there(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/s"
    S.take(items(spark, {("a", "1"): "x"}), folder)

    def broken(*_):
        raise RuntimeError("power cut")

    with monkeypatch.context() as m:
        m.setattr(S, "_commit", broken)
        with pytest.raises(RuntimeError):
            S.take(items(spark, {("a", "1"): "half"}), folder)
    assert S.committed(spark, folder) == [0]
    assert S.take(items(spark, {("a", "1"): "whole"}), folder) == 1
    assert held(spark, folder, 1) == {("a", "1"): "whole"} and held(spark, folder, 0) == {("a", "1"): "x"}
