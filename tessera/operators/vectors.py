"""A persistent index of vectors in lists: each vector lies with the centroid nearest to it, a search reads the lists whose
centroids are nearest to its queries.

``build`` fits the centroids by Lloyd rounds in Spark on a bounded sample (``sample`` vectors, smallest hashes first) and
writes every vector to its list; ``add`` deals more vectors to the same centroids, in place of those with the same ids.
Every write has a generation; of an id the newest committed one counts, and since the ids are written last, and every attempt
has a version of its own, a write that breaks off half-way changes nothing. Probing all lists is exact; fewer lists cost less and may miss neighbours (figures in
the README). An index has one width: vectors of another raise an error, null ones and those without a norm or with a
component that isn't finite are left out. ``realign`` rebuilds for another width from the vectors that have it and says
which ids must be embedded anew.

What reaches the driver is ``lists`` x width numbers a round. A search broadcasts its queries in blocks; vectors are never
shuffled: a task multiplies what it reads of a list with the queries that probe it, and keeps the k best of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Numbers of queries that are broadcast at a time.
MOST_VALUES = 8_000_000


def usable(vectors: DataFrame) -> DataFrame:
    """id, v: rows whose vector has a norm and finite components only."""
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def unit(column: pa.Array) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def width_of(rows: DataFrame, dims: int | None = None) -> int | None:
    """The one width of the vectors; an error if there are several, or another than ``dims``."""
    low, high = rows.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low is not None and (low != high or dims not in (None, low)):
        raise ValueError(f"the index has {dims or 'one'} dimension(s), vectors have {low}" + (f" to {high}" if high != low else ""))
    return low


def centroids_of(rows: DataFrame, lists: int, sample: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids of at most ``lists`` lists, fitted on at most ``sample`` rows."""
    some = cut(rows.select("v", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(sample))
    first = some.orderBy("h").limit(lists).toArrow().column("v").combine_chunks()  # ``lists`` rows
    centres = np.unique(unit(first), axis=0)
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(held.value), np.zeros(len(held.value), np.int64)  # noqa: B023
            for batch in batches:
                v = unit(batch.column(0))
                near = (v @ held.value.T).argmax(1)  # noqa: B023
                np.add.at(total, near, v)
                count += np.bincount(near, minlength=len(count))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], names=["list", "total"])

        added = some.select("v").mapInArrow(sums, "list long, total array<double>")
        places = added.select("list", F.posexplode("total").alias("place", "x")).groupBy("list", "place").agg(F.sum("x").alias("x"))
        found = places.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("total")).collect()
        new = centres.copy()  # a list that lost all its vectors keeps its centroid
        for r in found:
            norm = np.linalg.norm(r.total)
            new[r.list] = np.array(r.total) / norm if norm else centres[r.list]
        if np.allclose(new, centres):
            break
        centres = new
    drop_cut(some)
    return centres


def stored(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # ``lists`` rows
    return np.array([r.centre for r in rows])


def _write(rows: DataFrame, folder: str, centres: np.ndarray, generation: int) -> None:
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (unit(batch.column(1)) @ centres.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["id", "v", "list"])

    kind = rows.schema["id"].dataType.simpleString()
    one = rows.groupBy("id").agg(F.min("v").alias("v"))  # of rows that repeat an id the smallest vector
    version = f"{generation}-{uuid.uuid4().hex}"
    placed = one.mapInArrow(dealt, f"id {kind}, v array<double>, list int").withColumn("version", F.lit(version))
    parts = max(1, -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(centres)))
    placed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("append").partitionBy("list").parquet(f"{folder}/vectors")
    one.select("id", F.lit(generation).alias("generation"), F.lit(version).alias("version")).write.mode("append").parquet(f"{folder}/ids")  # the commit


def build(vectors: DataFrame, folder: str, lists: int = 100, sample: int = 50_000, rounds: int = 8, seed: int = 5) -> int:
    """Writes an index of vectors (id, embedding) to an empty ``folder``; gives its width."""
    spark, rows = vectors.sparkSession, usable(vectors)
    width = width_of(rows)
    if width is None:
        raise ValueError("no vectors to index")
    centres = centroids_of(rows, lists, sample, rounds, seed)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    _write(rows, folder, centres, 0)
    return width


def add(vectors: DataFrame, folder: str) -> int:
    """Adds vectors of the index's width, in place of those with the same ids; gives the generation."""
    spark, rows = vectors.sparkSession, usable(vectors)
    centres = stored(spark, folder)
    width_of(rows, centres.shape[1])
    generation = (spark.read.parquet(f"{folder}/ids").agg(F.max("generation")).first()[0] or 0) + 1
    _write(rows, folder, centres, generation)
    return generation


def live(spark: SparkSession, folder: str, lists: list[int] | None = None) -> DataFrame:
    """id, v, list of the vectors that count, of the given lists or all."""
    ids = spark.read.parquet(f"{folder}/ids")
    rows = spark.read.schema(f"id {ids.schema['id'].dataType.simpleString()}, v array<double>, version string, list int").parquet(f"{folder}/vectors")
    if lists is not None:
        rows = rows.where(F.col("list").isin(lists))
    versions = [r.version for r in ids.select("version").distinct().collect()]  # one for each write
    rows = rows.where(F.col("version").isin(versions))
    if len(versions) > 1:
        rows = rows.join(ids.groupBy("id").agg(F.max_by("version", "generation").alias("version")), ["id", "version"], "left_semi")
    return rows.select("id", "v", "list")


def realign(vectors: DataFrame, folder: str, dims: int, **options) -> DataFrame:
    """Builds an index of ``dims`` dimensions in the empty ``folder`` from the vectors that have them; gives the ids of those that haven't (or have no vector), to be embedded anew."""
    size = F.size(F.coalesce(F.col("embedding"), F.array()))
    fits = vectors.where(size == dims)
    if not usable(fits).isEmpty():
        build(fits, folder, **options)
    return vectors.where(size != dims).select("id")


def probed(queries: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the lists nearest to each query, queries x probes."""
    return np.argsort(-(queries @ centres.T), axis=1, kind="stable")[:, :probes]


def _nearest(held, k: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, lists = held.value
        best: pd.DataFrame | None = None
        for batch in batches:
            number = batch.column(2).to_numpy()
            for one in np.unique(number):
                asking = np.flatnonzero((lists == one).any(1))
                mine = np.flatnonzero(number == one)
                for at in range(0, len(mine) if len(asking) else 0, 4096):
                    part = batch.take(pa.array(mine[at : at + 4096]))
                    scores = np.round(q[asking] @ unit(part.column(1)).T, places)
                    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(asking), -2.0)
                    i, j = np.nonzero(scores >= least[:, None])  # equal scores all stay, the ids decide
                    new = pd.DataFrame({"q": asking[i], "id": part.column(0).to_pandas().to_numpy()[j], "score": scores[i, j]})
                    both = (new if best is None else pd.concat([best, new])).sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
                    best = both[both.groupby("q").cumcount() < k]
        if best is not None and len(best):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in best["q"]]), pa.array(best["id"].to_numpy()), pa.array(best["score"].to_numpy())], names=["question_id", "id", "score"])

    return run


def search(spark: SparkSession, queries: DataFrame, folder: str, k: int, probes: int | None = None, places: int = 9) -> DataFrame:
    """question_id, id, score (cosine), rank: the k nearest found for each query (question_id, embedding); all lists are probed if ``probes`` isn't given. Queries of another width than the index have no hits."""
    centres = stored(spark, folder)
    asked = usable(queries.select(F.col("question_id").alias("id"), "embedding")).where(F.size("v") == centres.shape[1])
    probes = len(centres) if probes is None else max(1, min(probes, len(centres)))
    n = asked.count() * centres.shape[1]
    blocks, out = max(1, -(-2 * n // MOST_VALUES) if n > MOST_VALUES else 1), None
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        table = mine.toArrow()  # a block at a time
        q = unit(table.column("v").combine_chunks()) if table.num_rows else np.zeros((0, centres.shape[1]))
        lists = probed(q, centres, probes)
        held = spark.sparkContext.broadcast((table.column("id").to_pylist(), q, lists))
        rows = live(spark, folder, np.unique(lists).tolist() if probes < len(centres) else None)
        kinds = f"question_id {asked.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, score double"
        part = rows.mapInArrow(_nearest(held, k, places), kinds)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether there is a committed index; a search channel without one has no hits."""
    try:
        spark.read.parquet(f"{folder}/ids")
        return True
    except AnalysisException:
        return False
