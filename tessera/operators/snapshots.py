"""Snapshots of a repository of items as a tree of hashes, with payloads kept once.

An item is (type, id, hash, payload). Items lie in ``16 ** DEPTH`` leaves by a hash of their key; a leaf's hash is made of
sums over its items, so it is one aggregate whatever the leaf's size, and a node's hash of its children's. A snapshot writes
the leaves that differ from the snapshot before, and of their payloads those that no snapshot holds yet; for all other
leaves its tree names the snapshot that wrote them. The tree, of a fixed size, is put in place by one rename, which is the
commit.

A diff compares trees from the root down, where hashes differ, and reads the items of the leaves in which it ends: rows in
proportion to the change. Rolling back commits the tree of an earlier snapshot again and writes no item. Names (a baseline,
say) can be given to snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .tables import _files

#: Hexadecimal digits of a leaf's prefix.
DEPTH = 3
ITEM = "type string, id string, hash string, leaf string"
TREE = "prefix string, hash string, written long"


def leaf_of(kind, name):
    return F.substring(F.sha2(F.concat_ws("\x00", kind, name), 256), 1, DEPTH)


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The snapshots that stand, in order."""
    files, path = _files(spark, folder)
    at = path(f"{folder}/trees")
    names = [str(s.getPath().getName()) for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-"))


def tree(spark: SparkSession, folder: str, snapshot: int) -> dict[str, tuple[str, int]]:
    """prefix: (hash, the snapshot that wrote the leaf) of all nodes; some (16 ** (DEPTH + 1)) / 15 at most."""
    rows = spark.read.schema(TREE).json(f"{folder}/trees/snapshot-{snapshot}").collect()
    return {r.prefix: (r.hash, r.written) for r in rows}


def _rolled_up(spark: SparkSession, leaves: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The leaves and all nodes above them."""
    from hashlib import sha256

    out, level = list(leaves), leaves
    for depth in range(DEPTH - 1, -1, -1):
        children: dict[str, list[tuple[str, str]]] = {}
        for prefix, digest, _ in level:
            children.setdefault(prefix[:depth], []).append((prefix, digest))
        level = [(p, sha256(repr(sorted(c)).encode()).hexdigest(), -1) for p, c in children.items()]
        out += level
    return out


def _commit(spark: SparkSession, folder: str, snapshot: int, leaves: list[tuple[str, str, int]]) -> None:
    files, path = _files(spark, folder)
    attempt = f"{folder}/trees/_attempt-{snapshot}"
    nodes = _rolled_up(spark, leaves) or [("", "", -1)]
    spark.createDataFrame(nodes, TREE).coalesce(1).write.mode("overwrite").json(attempt)
    if not files.rename(path(attempt), path(f"{folder}/trees/snapshot-{snapshot}")):
        raise RuntimeError(f"snapshot {snapshot} could not be put in place")


def differing(a: dict[str, tuple[str, int]], b: dict[str, tuple[str, int]]) -> list[str]:
    """The leaves in which two trees differ, found from the root down."""
    out, open_ = [], [""]
    while open_:
        node = open_.pop()
        if a.get(node, ("",))[0] == b.get(node, ("",))[0]:
            continue
        if len(node) == DEPTH:
            out.append(node)
        else:
            open_ += [node + digit for digit in "0123456789abcdef"]
    return sorted(out)


def _items(spark: SparkSession, folder: str, nodes: dict[str, tuple[str, int]], leaves: list[str] | None = None) -> DataFrame:
    """type, id, hash, leaf of the named leaves (or all) of a tree, from the snapshots that wrote them."""
    by: dict[int, list[str]] = {}
    for leaf in leaves if leaves is not None else [p for p in nodes if len(p) == DEPTH]:
        if leaf in nodes:
            by.setdefault(nodes[leaf][1], []).append(leaf)
    out = spark.createDataFrame([], ITEM)
    for written, mine in sorted(by.items()):
        rows = spark.read.schema(ITEM).parquet(f"{folder}/items/snapshot-{written}")
        out = out.unionByName(rows.where(F.col("leaf").isin(mine)))
    return out


def take(items: DataFrame, folder: str) -> int:
    """Commits a snapshot of items (type, id, hash, payload); gives its number. Of rows that repeat a key the smallest counts."""
    spark = items.sparkSession
    had = committed(spark, folder)
    snapshot = had[-1] + 1 if had else 0
    before = tree(spark, folder, had[-1]) if had else {}
    keyed = items.where("type is not null and id is not null").groupBy("type", "id").agg(F.min(F.struct("hash", "payload")).alias("x")).select("type", "id", "x.hash", "x.payload", leaf_of(F.col("type"), F.col("id")).alias("leaf"))
    rows = cut(keyed)
    whole = F.sha2(F.concat_ws("\x00", "type", "id", "hash"), 256)
    number = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(number(1)).alias("a"), F.sum(number(16)).alias("b"), F.sum(number(31)).alias("c"))
    now = {r.leaf: r.hash for r in sums.select("leaf", F.sha2(F.concat_ws(",", "n", "a", "b", "c"), 256).alias("hash")).collect()}  # a row for each leaf
    changed = [p for p, h in now.items() if before.get(p, ("",))[0] != h]
    fresh = rows.where(F.col("leaf").isin(changed))
    fresh.select("type", "id", "hash", "leaf").repartition("leaf").sortWithinPartitions("leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{folder}/items/snapshot-{snapshot}")
    new = fresh.select("hash", "payload").dropDuplicates(["hash"])
    if had:
        held = _payloads(spark, folder, had)
        new = new.join(held.select("hash"), "hash", "left_anti")
    new.withColumn("part", F.substring("hash", 1, 2)).repartition("part").sortWithinPartitions("part", "hash").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/payloads/snapshot-{snapshot}")
    _commit(spark, folder, snapshot, [(p, h, snapshot if p in set(changed) else before[p][1]) for p, h in sorted(now.items())])
    drop_cut(rows)
    return snapshot


def _payloads(spark: SparkSession, folder: str, snapshots: list[int]) -> DataFrame:
    files, path = _files(spark, folder)
    paths = [p for s in snapshots if files.exists(path(p := f"{folder}/payloads/snapshot-{s}"))]  # rolled back ones have none
    rows = [spark.read.schema("hash string, payload string, part string").parquet(p) for p in paths]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def diff(spark: SparkSession, folder: str, old: int, new: int) -> DataFrame:
    """type, id, change (ADDED, REMOVED, MODIFIED), old_hash, new_hash between two snapshots."""
    a, b = tree(spark, folder, old), tree(spark, folder, new)
    leaves = differing(a, b)
    x = _items(spark, folder, a, leaves).select("type", "id", F.col("hash").alias("old_hash"))
    y = _items(spark, folder, b, leaves).select("type", "id", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "ADDED").when(F.col("new_hash").isNull(), "REMOVED").when(F.col("old_hash") != F.col("new_hash"), "MODIFIED")
    return x.join(y, ["type", "id"], "full").select("type", "id", change.alias("change"), "old_hash", "new_hash").where("change is not null")


def read(spark: SparkSession, folder: str, snapshot: int) -> DataFrame:
    """type, id, hash, payload of a snapshot."""
    items = _items(spark, folder, tree(spark, folder, snapshot))
    return items.join(_payloads(spark, folder, committed(spark, folder)).select("hash", "payload"), "hash").select("type", "id", "hash", "payload")


def undo(spark: SparkSession, folder: str, old: int, new: int) -> DataFrame:
    """type, id, action (WRITE, DELETE), payload: what turns the items of ``new`` into those of ``old``; payloads are read for what changed."""
    changes = diff(spark, folder, old, new)
    action = F.when(F.col("change") == "ADDED", "DELETE").otherwise("WRITE")
    payloads = _payloads(spark, folder, committed(spark, folder)).select(F.col("hash").alias("old_hash"), "payload")
    return changes.join(payloads, "old_hash", "left").select("type", "id", action.alias("action"), F.when(F.col("change") != "ADDED", F.col("payload")).alias("payload"))


def roll_back(spark: SparkSession, folder: str, to: int) -> int:
    """Commits the tree of an earlier snapshot as the newest one; gives its number."""
    had = committed(spark, folder)
    if to not in had:
        raise ValueError(f"there is no snapshot {to}")
    _commit(spark, folder, had[-1] + 1, [(p, h, w) for p, (h, w) in tree(spark, folder, to).items() if len(p) == DEPTH])
    return had[-1] + 1


def name(spark: SparkSession, folder: str, snapshot: int, label: str) -> None:
    """Gives a snapshot a name, in place of one that had it before."""
    if snapshot not in committed(spark, folder):
        raise ValueError(f"there is no snapshot {snapshot}")
    spark.createDataFrame([(snapshot,)], "snapshot long").coalesce(1).write.mode("overwrite").json(f"{folder}/names/{label}")


def named(spark: SparkSession, folder: str, label: str) -> int:
    return spark.read.schema("snapshot long").json(f"{folder}/names/{label}").first()[0]
