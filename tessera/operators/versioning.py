"""Upserts without a table format, history, snapshots, diffs, exports. Results are written to new paths, never over what the plan reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base with the rows of delta in place of those with equal keys (nulls are equal)."""
    test = None
    left, right = base.alias("l"), delta.select(*keys).distinct().alias("r")
    for k in keys:
        part = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        test = part if test is None else test & part
    return left.join(right, test, "left_anti").unionByName(delta)


def with_search_text(articles: DataFrame) -> DataFrame:
    """Adds the search columns that are filled at write time."""
    rows = articles.withColumn("search_text", F.concat_ws("\n", "title", "summary", "content", "metadata"))
    return rows.withColumn("refkey_text", F.concat_ws(" ", "concept_id", "title", F.array_join("keywords", " ")))


def history_rows(delta: DataFrame, reason: str, at) -> DataFrame:
    """What an upsert appends to the history."""
    return delta.withColumn("snapshot_reason", F.lit(reason)).withColumn("captured_at", at)


def last_n(history: DataFrame, key: str, n: int) -> DataFrame:
    """The latest n rows of each key with their number (captured_at, then id)."""
    return history.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("captured_at"), F.desc("id")))).where(F.col("n") <= n)


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), tie))).where("_n = 1").drop("_n")


def rollback(articles: DataFrame, history: DataFrame, picks: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """Articles with the picked snapshots (article_key, snapshot_id) restored, and the history rows this adds; a snapshot of another article counts as none."""
    chosen = history.join(picks.select("article_key", F.col("snapshot_id").alias("id")), ["article_key", "id"])
    restored = chosen.select(*articles.columns)
    added = chosen.withColumn("snapshot_reason", F.concat(F.lit("rollback|from:"), F.col("id").cast("string"))).withColumn("captured_at", at)
    return upsert(articles, restored, ["article_key"]), added


def repo_items(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """type, id, hash, payload of every row of the tables (name: rows, id column)."""
    out = None
    for name, (rows, key) in tables.items():
        payload = F.to_json(F.struct(*sorted(rows.columns)))
        part = rows.select(F.lit(name).alias("type"), F.col(key).cast("string").alias("id"), F.sha2(payload, 256).alias("hash"), payload.alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """type, id, change of items that were added, removed or modified."""
    a, b = old.select("type", "id", F.col("hash").alias("h1")), new.select("type", "id", F.col("hash").alias("h2"))
    change = F.when(F.col("h1").isNull(), "ADDED").when(F.col("h2").isNull(), "REMOVED").when(F.col("h1") != F.col("h2"), "MODIFIED")
    return a.join(b, ["type", "id"], "full").select("type", "id", change.alias("change")).where("change IS NOT NULL")


def restore(items: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of one type from their payloads."""
    return items.where(F.col("type") == kind).select(F.from_json("payload", schema).alias("p")).select("p.*")


def export_actions(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, action: WRITE what is new or changed, SKIP what is equal, DELETE what is gone."""
    a, b = current.select("path", F.col("hash").alias("h1")), manifest.select("path", F.col("hash").alias("h2"))
    action = F.when(F.col("h1").isNull(), "DELETE").when(F.col("h1").eqNullSafe(F.col("h2")), "SKIP").otherwise("WRITE")
    return a.join(b, "path", "full").select("path", action.alias("action"))


def import_actions(files: DataFrame, manifest: DataFrame, current: DataFrame) -> DataFrame:
    """path, action from three hashes: SKIP an unedited file, CONFLICT where both sides changed, else SYNC."""
    h = lambda df, n: df.select("path", F.col("hash").alias(n))
    rows = h(files, "f").join(h(manifest, "m"), "path", "left").join(h(current, "c"), "path", "left")
    action = F.when(F.col("f").eqNullSafe(F.col("m")) | F.col("f").eqNullSafe(F.col("c")), "SKIP").when(F.col("c").isNotNull() & ~F.col("c").eqNullSafe(F.col("m")), "CONFLICT").otherwise("SYNC")
    return rows.select("path", action.alias("action"))


def resolve(references: DataFrame, articles: DataFrame) -> DataFrame:
    """ref, source_id, article_key, by: an article by key, else by source and concept, else by concept (the latest compiled)."""
    pick = lambda by: articles.groupBy(*by).agg(F.max_by("article_key", F.struct("compiled_at", "article_key")).alias("found"))
    key = articles.select(F.col("article_key").alias("ref"), F.col("article_key").alias("k1")).distinct()
    scoped = pick([F.col("concept_id").alias("ref"), "source_id"]).withColumnRenamed("found", "k2")
    concept = pick([F.col("concept_id").alias("ref")]).withColumnRenamed("found", "k3")
    rows = references.join(key, "ref", "left").join(scoped, ["ref", "source_id"], "left").join(concept, "ref", "left")
    by = F.when(F.col("k1").isNotNull(), "key").when(F.col("k2").isNotNull(), "scoped").when(F.col("k3").isNotNull(), "concept").otherwise("none")
    return rows.select("ref", "source_id", F.coalesce("k1", "k2", "k3").alias("article_key"), by.alias("by"))


def lookup(references: DataFrame, articles: DataFrame, files: DataFrame) -> DataFrame:
    """ref, kind, found: an article, else a source file by either path (the newest), else nothing."""
    found = resolve(references, articles)
    paths = files.select(F.explode(F.array_distinct(F.array("file_path", "relative_path"))).alias("ref"), "id")
    newest = paths.groupBy("ref").agg(F.max("id").alias("file_id"))
    rows = found.join(newest, "ref", "left")
    kind = F.when(F.col("article_key").isNotNull(), "ARTICLE").when(F.col("file_id").isNotNull(), "SOURCE_FILE").otherwise("NOT_FOUND")
    return rows.select("ref", kind.alias("kind"), F.coalesce("article_key", F.col("file_id").cast("string")).alias("found"))
