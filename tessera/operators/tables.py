"""Tables that are replaced owner by owner, batch by batch, with their history: a commit is one manifest.

A table lies in ``buckets`` of owners (an article and its chunks, say). A batch reads the buckets that its owners lie in,
writes them anew under its own number, appends what changed to the history under the same number, and at last puts a
manifest in place by one rename: for each bucket the batch that wrote it. Readers follow the newest manifest and nothing
else. So a batch that breaks off half-way leaves no trace but files that nobody reads, which its next try overwrites; a
batch that is played again after its commit changes nothing; and table and history change together. ``stream`` feeds a table
from a stream, whose batch numbers it keeps.

A manifest has a row for each bucket, whatever the size of the table. Batches of one table are to be applied by one writer
at a time, with growing numbers (as Structured Streaming does).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _delete

BUCKETS = 64


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose manifests stand, in order."""
    files, path = _files(spark, folder)
    at = path(f"{folder}/manifest")
    if not files.exists(at):
        return []
    names = [str(s.getPath().getName()) for s in files.listStatus(at)]
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))


def manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int, int], int]:
    """The last batch (-1: none), the batch that wrote each bucket, and the number of buckets."""
    batches = committed(spark, folder)
    if not batches:
        return -1, {}, BUCKETS
    rows = spark.read.schema("bucket int, batch long, buckets int").json(f"{folder}/manifest/batch-{batches[-1]}").collect()  # a row for each bucket
    return batches[-1], {r.bucket: r.batch for r in rows if r.bucket is not None}, rows[0].buckets


def bucket_of(owner, buckets: int):
    return F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int")


def read(spark: SparkSession, folder: str, owners: list | None = None) -> DataFrame:
    """The table as of the last commit; with ``owners`` only their rows, from their buckets."""
    last, held, buckets = manifest(spark, folder)
    if last < 0:
        raise ValueError(f"no table in {folder}")
    schema = spark.read.parquet(f"{folder}/schema").schema
    owner = schema.fieldNames()[0]
    if owners is not None:
        values = spark.createDataFrame([(x,) for x in owners], f"o {schema[owner].dataType.simpleString()}")
        wanted = {r.b for r in values.select(bucket_of(F.col("o"), buckets).alias("b")).collect()}
        held = {b: v for b, v in held.items() if b in wanted}
    rows = _buckets(spark, folder, held, schema)
    return rows if owners is None else rows.where(F.col(owner).isin(owners))


def _buckets(spark: SparkSession, folder: str, held: dict[int, int], schema) -> DataFrame:
    files, path = _files(spark, folder)
    paths = [p for b, v in sorted(held.items()) if files.exists(path(p := f"{folder}/data/batch={v}/bucket={b}"))]  # an emptied bucket has no files
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _commit(spark: SparkSession, folder: str, batch: int, held: dict[int, int], buckets: int) -> None:
    files, path = _files(spark, folder)
    attempt = f"{folder}/manifest/_attempt-{batch}"
    rows = [(b, v, buckets) for b, v in sorted(held.items())] or [(None, None, buckets)]
    spark.createDataFrame(rows, "bucket int, batch long, buckets int").coalesce(1).write.mode("overwrite").json(attempt)
    if not files.rename(path(attempt), path(f"{folder}/manifest/batch-{batch}")):
        raise RuntimeError(f"the manifest of batch {batch} could not be put in place")


def _write(rows: DataFrame, folder: str, batch: int, buckets: int) -> None:
    owner = rows.columns[0]
    parts = max(1, -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    dealt = rows.withColumn("bucket", bucket_of(F.col(owner), buckets)).repartition("bucket", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(parts)))
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/batch={batch}")


def replace(rows: DataFrame, folder: str, batch: int, owners: DataFrame | None = None, reason: str = "replace", buckets: int = BUCKETS) -> bool:
    """Puts ``rows`` (their first column is the owner) in place of all rows of their owners and of ``owners`` (its first column; an owner without rows is deleted). False if the batch was committed before. Rows without an owner are left out; a table keeps its columns and its number of buckets."""
    spark = rows.sparkSession
    last, held, kept = manifest(spark, folder)
    if batch <= last:
        return False
    buckets = kept if last >= 0 else buckets
    owner, rows = rows.columns[0], rows.where(F.col(rows.columns[0]).isNotNull())
    if last < 0:
        spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{folder}/schema")
        old = spark.createDataFrame([], rows.schema)
    named = rows.select(owner)
    if owners is not None:
        named = named.unionByName(owners.select(F.col(owners.columns[0]).alias(owner)).where(F.col(owner).isNotNull()))
    named = named.distinct()
    touched = {r.b for r in named.select(bucket_of(F.col(owner), buckets).alias("b")).distinct().collect()}  # ``buckets`` numbers at most
    if last >= 0:
        schema = spark.read.parquet(f"{folder}/schema").schema
        old = _buckets(spark, folder, {b: v for b, v in held.items() if b in touched}, schema)
        rows = rows.select(*schema.fieldNames())
    _write(old.join(named, owner, "left_anti").unionByName(rows), folder, batch, buckets)
    # what each owner had and has: counts of rows and a hash of them in any order
    digest = lambda df, n: df.groupBy(owner).agg(F.count("*").alias(f"rows_{n}"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.sha2(F.to_json(F.struct(*df.columns)), 256)))), 256).alias(f"hash_{n}"))
    change = F.when(F.col("hash_old").isNull() & F.col("hash_new").isNull(), "NONE").when(F.col("hash_old").isNull(), "ADDED").when(F.col("hash_new").isNull(), "REMOVED").when(F.col("hash_old") == F.col("hash_new"), "SAME").otherwise("CHANGED")
    changes = named.join(digest(old, "old"), owner, "left").join(digest(rows, "new"), owner, "left")
    changes = changes.select(owner, F.lit(batch).cast("long").alias("batch"), F.lit(reason).alias("reason"), change.alias("change"), F.coalesce("rows_old", F.lit(0)).alias("rows_old"), F.coalesce("rows_new", F.lit(0)).alias("rows_new"), "hash_old", "hash_new").where("change != 'NONE'")
    changes.write.mode("overwrite").parquet(f"{folder}/history/batch-{batch}")
    _commit(spark, folder, batch, held | {b: batch for b in touched}, buckets)
    return True


def rebuild(rows: DataFrame, folder: str, batch: int, buckets: int = BUCKETS) -> bool:
    """The whole table anew; owners that aren't in ``rows`` go."""
    spark = rows.sparkSession
    last = manifest(spark, folder)[0]
    if batch <= last:
        return False
    owners = read(spark, folder).select(rows.columns[0]).distinct() if last >= 0 else None
    return replace(rows, folder, batch, owners, "rebuild", buckets)


def upsert(rows: DataFrame, folder: str, batch: int, order: str | None = None, buckets: int = BUCKETS) -> bool:
    """One row for each owner: those of ``rows`` in place of the old ones; of rows that repeat an owner the one with the largest ``order`` (then the largest row)."""
    owner = rows.columns[0]
    key = F.struct(*([F.col(order)] if order else []), *rows.columns)
    one = rows.groupBy(owner).agg(F.max_by(F.struct(*rows.columns), key).alias("row")).select("row.*")
    return replace(one, folder, batch, None, "upsert", buckets)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """owner, batch, reason, change, rows_old, rows_new, hash_old, hash_new of every owner that a committed batch named."""
    paths = [f"{folder}/history/batch-{b}" for b in committed(spark, folder)]
    if not paths:
        raise ValueError(f"no table in {folder}")
    return spark.read.parquet(*paths)


def stream(source: DataFrame, folder: str, checkpoint: str, apply=replace, **options):
    """A started query that applies each micro-batch of ``source`` to the table; what was committed before a restart isn't applied again."""
    return source.writeStream.foreachBatch(lambda rows, batch: apply(rows, folder, batch, **options) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vacuum(spark: SparkSession, folder: str) -> None:
    """Deletes files that the last commit doesn't read; the history stays."""
    last, held, _ = manifest(spark, folder)
    files, path = _files(spark, folder)
    for status in files.listStatus(path(f"{folder}/data")) if last >= 0 else []:
        batch = int(str(status.getPath().getName()).removeprefix("batch="))
        mine = {b for b, v in held.items() if v == batch}
        if not mine and batch <= last:
            _delete(spark, f"{folder}/data/batch={batch}")
        elif batch <= last:
            for part in files.listStatus(status.getPath()):
                name = str(part.getPath().getName())
                if name.startswith("bucket=") and int(name.removeprefix("bucket=")) not in mine:
                    _delete(spark, str(part.getPath()))


def exists(spark: SparkSession, folder: str) -> bool:
    try:
        return manifest(spark, folder)[0] >= 0
    except AnalysisException:
        return False
