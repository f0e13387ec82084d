"""Connected components of an edge table: tasks join their own edges first, then alternating large and small stars; no edge or label reaches the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Edges (of 16 bytes) that a task joins at a time; less than what Spark itself puts into one partition.
CHUNK = 1 << 16


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links a-b."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def stars(chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (a, b) as stars (a, the smallest node that it reaches), of so many edges at a time; what a chunk leaves is no more than its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def joint() -> np.ndarray:
            names, c = np.unique(np.concatenate(held), return_inverse=True)
            a, b = c.reshape(-1, 2).T
            lab = joined(a, b, len(names))
            moved = np.flatnonzero(lab != np.arange(len(names)))
            return np.stack([names[moved], names[lab[moved]]], 1)

        def batch_of(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            both = np.stack([batch.column(k).to_numpy() for k in (0, 1)], 1)
            for at in range(0, len(both), chunk):
                held.append(both[at : at + chunk])
                size += len(held[-1])
                if size >= chunk:
                    x = joint()
                    if 2 * len(x) > chunk:  # few of them were one component
                        yield batch_of(x)
                        x = x[:0]
                    held, size = [x], len(x)
        if size:
            yield batch_of(joint())

    return run


def _settled(e: DataFrame, rounds: int) -> DataFrame:
    """Edges (a > b) as stars, by rounds of which each is a partial aggregate and a join that Spark can split; a long chain halves in each."""
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop_cut(large)
        drop_cut(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e
        state = now
    raise RuntimeError("components didn't settle")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b: long). What fits one chunk once tasks have joined their own edges needs no rounds."""
    edge = "a long, b long"
    e = cut(edges.where("a != b").select("a", "b").mapInArrow(stars(CHUNK), edge))
    if e.count() > CHUNK:
        e = _settled(e.distinct(), rounds)
    else:
        one = cut(e.coalesce(1).mapInArrow(stars(2 * CHUNK), edge))
        drop_cut(e)
        e = one
    found = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
