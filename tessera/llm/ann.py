"""Approximate nearest neighbours by largest inner product over shifted space-filling curves.

Vectors are scaled by the largest norm and given one more coordinate that makes all norms equal, so the largest inner
product is the nearest point. ``curves`` random projections to ``dims`` coordinates, each shifted at random, are quantised
and put in Hilbert order; Spark range-partitions (curve, position), which gives every vector its rank on each curve. On each
curve a query looks at the vectors at most ``reach`` ranks away, in blocks of at most BLOCK vectors. On the curves vectors
travel as one signed byte a coordinate with a scale; a task holds one block and streams the queries past it, and merges what
it finds for a query before it emits. The best of all blocks and curves are merged, and those few more than k that are left
are reranked by exact products of the original vectors, each summed in one fixed order.

The reach is measured, not set: the true nearest of at most ``pilots`` queries (those with the smallest hashes of their ids)
are found by one pass of exact products over all vectors, and for each of them the curve is taken that brings it nearest to
its query. A share ``recall`` of these pairs lies within the reach, at every size of the table. Clustered vectors need a
short reach, isotropic ones one that grows with the table (figures in the README). With a given
``reach`` of all rows, on one curve, every vector is a candidate, and only the bytes' rounding beyond SPARE places can lose one.

Identical vectors are one point of the index that stands for up to k+1 smallest ids, which is all that can be among a
query's k nearest, so a vector shared by a third of all rows costs no more than another.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those whose length isn't
the most frequent one, nor rows with a null vec_id; of rows that repeat a vec_id the smallest vector counts. A table
with no vectors gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .hilbert import hilbert


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("embedding") == (sizes[0][0] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def keys(x: np.ndarray, curves: int, dims: int, bits: int, seed: int) -> np.ndarray:
    """Curve positions of unit vectors, curves x n."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    dims = min(dims, d)
    spread = 3.5 / np.sqrt(d)  # of a coordinate of a unit vector
    out = np.zeros((curves, len(x)), np.uint64)
    for c in range(curves):
        axes = np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims]
        at = (np.clip(x @ axes / spread, -1, 1) + 1) / 4 + rng.random(dims) / 2
        out[c] = hilbert(np.minimum((at * 2**bits).astype(np.int64), 2**bits - 1), bits)
    return out


#: Candidates beyond k that are reranked by exact products, for what the bytes round away.
SPARE = 12
#: Queries whose best a task holds at a time.
HELD = 50_000
#: Vectors that a task holds at a time, at most.
BLOCK = 2048


def _curved(top: float, curves: int, dims: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v, gid = matrix(part.column(1)), part.column(0).to_numpy()
                norm = np.linalg.norm(v, axis=1)
                points = np.column_stack([v / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))])
                asked = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                seekers = np.column_stack([v / norm[:, None], np.zeros(len(v))])[asked]
                data, query = keys(points, curves, dims, bits, seed), keys(seekers, curves, dims, bits, seed)
                scale = np.abs(v).max(1) / 127
                coded = [x.tobytes() for x in np.rint(v / scale[:, None]).astype(np.int8)]
                whole = [x.tobytes() for x in v[asked].astype(np.float32)]
                for role, ids, where, code, factor in ((0, gid, data, coded, scale), (1, gid[asked], query, whole, np.ones(int(asked.sum())))):
                    n, code = len(ids), pa.array(code, pa.binary())
                    for c in range(curves if n else 0):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c, np.int32)), pa.array(where[c].astype(np.int64)), pa.array(np.full(n, role, np.int32)), pa.array(ids), pa.array(factor), code], names=["curve", "position", "role", "gid", "scale", "code"])

    return run


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of indexed vectors before each row on its curve within this partition; rows come sorted."""
    part, curve, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        c, role = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        index = np.zeros(len(c), np.int64)
        for k in np.unique(c):
            mine = c == k
            seen = seen if k == curve else 0
            data = (role[mine] == 0).astype(np.int64)
            index[mine] = seen + np.cumsum(data) - data
            curve, seen = k, seen + int(data.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(c), part, np.int32)), pa.array(index)], names=[*batch.schema.names, "part", "index"])


class Best:
    """The best few of each query so far."""

    def __init__(self, k: int):
        self.k, self.row = k, {}
        self.score, self.who = np.full((1024, k), -np.inf), np.full((1024, k), -1)

    def rows(self, queries: list[int]) -> np.ndarray:
        out = np.array([self.row.setdefault(q, len(self.row)) for q in queries], np.int64)
        while len(self.row) > len(self.score):
            self.score = np.vstack([self.score, np.full_like(self.score, -np.inf)])
            self.who = np.vstack([self.who, np.full_like(self.who, -1)])
        return out

    def add(self, queries: list[int], gid: np.ndarray, scores: np.ndarray) -> None:
        """Scores: queries x gid. A vector met on several curves has the same score on all and counts once."""
        at = self.rows(queries)
        i, j = np.nonzero(scores > self.score[at, -1:])
        new = ~(self.who[at[i]] == gid[j][:, None]).any(1)
        i, j = i[new], j[new]
        if not len(i):
            return
        some, inverse = np.unique(i, return_inverse=True)
        count = np.bincount(inverse)
        place = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        more, names = np.full((len(some), count.max()), -np.inf), np.full((len(some), count.max()), -1)
        more[inverse, place], names[inverse, place] = scores[i, j], gid[j]
        both, who = np.hstack([self.score[at[some]], more]), np.hstack([self.who[at[some]], names])
        order = np.lexsort((who, -both), axis=1)[:, : self.k]
        self.score[at[some]], self.who[at[some]] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)

    def flush(self) -> pa.RecordBatch:
        ids = np.array(list(self.row), np.int64)
        row, col = np.nonzero(self.score[: len(ids)] > -np.inf)
        out = pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(self.who[row, col]), pa.array(self.score[row, col])], names=["query", "gid", "score"])
        self.__init__(self.k)
        return out


def _best(k: int):
    """Streams rows sorted by (curve, block, role): holds a block's vectors, and lets the queries pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key, block, gids = Best(k), None, [], []
        for batch in batches:
            curve, number, role, gid, scale = (batch.column(i).to_numpy() for i in range(5))
            cuts = [0, *(np.flatnonzero((curve[1:] != curve[:-1]) | (number[1:] != number[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if (curve[lo], number[lo]) != key:
                    key, block, gids = (curve[lo], number[lo]), [], []
                raw = b"".join(batch.column(5).slice(lo, hi - lo).to_pylist())
                if role[lo] == 0:
                    block.append(np.frombuffer(raw, np.int8).reshape(hi - lo, -1) * scale[lo:hi, None].astype(np.float32))
                    gids.append(gid[lo:hi])
                elif block:
                    v, names = np.concatenate(block), np.concatenate(gids)
                    block, gids = [v], [names]
                    q = np.frombuffer(raw, np.float32).reshape(hi - lo, -1)
                    for at in range(0, len(q), 1024):
                        best.add(gid[lo + at : min(hi, lo + at + 1024)].tolist(), names, (q[at : at + 1024] @ v.T).astype(np.float64))
                    if len(best.row) > HELD:
                        yield best.flush()
        if best.row:
            yield best.flush()

    return run


def _products(pilots, k: int):
    """query, gid, score: each batch's k best vectors for each pilot, but for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = pilots.value
        best = Best(k + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                best.add(names, part.column(0).to_numpy(), q @ matrix(part.column(1)).T)
        if best.row:
            yield best.flush()

    return run


def needed(points: DataFrame, placed: DataFrame, k: int, recall: float, pilots: int) -> int:
    """How many ranks a query must look to either side to meet a share ``recall`` of the pilots' true neighbours on some curve."""
    first = points.where("asked").orderBy(F.xxhash64("gid"), "gid").limit(pilots).select("gid", "embedding").collect()
    if not first:
        return 1
    shared = points.sparkSession.sparkContext.broadcast(([r.gid for r in first], np.array([r.embedding for r in first])))
    near = points.select("gid", "embedding").mapInArrow(_products(shared, k), "query long, gid long, score double").where("query <> gid")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "gid"))).where(F.col("place") <= k)
    pairs = cut(near.select("query", "gid"))  # pilots * k rows at most
    there = placed.where("role = 0").select("curve", "gid", "at").join(F.broadcast(pairs), "gid")
    here = placed.where("role = 1").select("curve", F.col("gid").alias("query"), F.col("at").alias("own")).join(F.broadcast(pairs.select("query").distinct()), "query")
    gaps = there.join(here, ["curve", "query"]).groupBy("query", "gid").agg(F.min(F.abs(F.col("at") - F.col("own"))).alias("gap"))
    return max(1, gaps.agg(F.expr(f"percentile_disc({recall}) within group (order by gap)")).first()[0] or 1)


def search(vectors: DataFrame, every: int = 20, k: int = 20, curves: int = 72, dims: int = 12, bits: int = 3, recall: float = 0.95, pilots: int = 64, reach: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by ``every``."""
    rows = cut(usable(vectors))
    asks = F.col("vec_id") % every == 0
    points = rows.groupBy("embedding").agg(F.min("vec_id").alias("gid"), F.max(asks).alias("asked"))
    points = cut(points)
    n, top = points.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()
    curved = points.select("gid", "embedding", "asked").mapInArrow(_curved(top or 1.0, curves, dims, bits, seed), "curve int, position long, role int, gid long, scale double, code binary")
    ordered = curved.repartitionByRange("curve", "position", "gid", "role").sortWithinPartitions("curve", "position", "gid", "role")
    ranked = cut(ordered.mapInArrow(_ranked, "curve int, position long, role int, gid long, scale double, code binary, part int, index long"))
    sizes = ranked.where("role = 0").groupBy("curve", "part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("curve", "part", "before")
    # one row for each partition and curve: as many as tasks, not as rows; parts of queries alone follow their curve's last
    parts = ranked.select("curve", "part").distinct().join(before, ["curve", "part"], "left")
    parts = parts.withColumn("before", F.coalesce("before", F.max(F.col("before")).over(Window.partitionBy("curve").orderBy("part")), F.lit(0)))
    placed = ranked.join(cut(parts), ["curve", "part"]).withColumn("at", F.col("index") + F.col("before"))
    reach = reach or needed(points, placed, k, recall, pilots)
    size = min(BLOCK, max(16, reach))
    block = lambda at: F.floor(F.greatest(F.lit(0), F.least(at, F.lit(n - 1))) / size)
    near = F.sequence(block(F.col("at") - reach), block(F.col("at") + reach))
    dealt = placed.select("curve", F.explode(F.when(F.col("role") == 0, F.array(block(F.col("at")))).otherwise(near)).alias("block"), "role", "gid", "scale", "code")
    dealt = dealt.repartition("curve", "block").sortWithinPartitions("curve", "block", "role", "gid")
    found = dealt.mapInArrow(_best(k + 1 + SPARE), "query long, gid long, score double").groupBy("query", "gid").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "gid")
    few = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1 + SPARE).select("query", "gid")
    # one product for each pair, in one order
    pairs = few.join(points.select(F.col("gid").alias("query"), F.col("embedding").alias("q")), "query").join(points.select("gid", F.col("embedding").alias("v")), "gid")
    exact = pairs.select("query", "gid", F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))
    best = exact.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")
    # each point stands for its k+1 smallest ids
    members = rows.join(points.select("embedding", "gid"), "embedding").select("gid", "vec_id")
    few = members.withColumn("place", F.row_number().over(Window.partitionBy("gid").orderBy("vec_id"))).where(F.col("place") <= k + 1).groupBy("gid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    listed = best.join(few, "gid").groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("key"), "ids"))).alias("points"))  # k+1 points at most
    flat = F.array_sort(F.flatten(F.transform("points", lambda p: F.transform(p["ids"], lambda i: F.struct(p["key"].alias("key"), i.alias("id"))))))
    listed = listed.select("query", F.slice(flat, 1, k + 1).alias("hits"))
    seekers = members.where(F.col("vec_id") % every == 0).select(F.col("gid").alias("query"), F.col("vec_id").alias("query_id"))
    own = seekers.join(listed, "query").select("query_id", F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k).alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.key")).alias("score"))
