"""The knowledge tables (files, articles, questions, ...) seen in the plain input tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view as (input table, columns); {concat} etc. need no dialect: the expressions are the same in both.
FILES = """doc_id AS id, doc_id % 20 AS source_id, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 10 = 3 THEN '.png' WHEN doc_id % 10 = 4 THEN '.md' ELSE '.txt' END AS path,
 coalesce(text, '') AS content, n_chars AS size, lang, source"""
ARTICLES = """doc_id, CAST(floor(doc_id / 100) AS BIGINT) AS source_id, 'doc-' || doc_id AS article_key, 'c' || doc_id AS concept_id, substr(coalesce(text, ''), 1, 40) AS title, coalesce(text, '') AS content,
 CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(coalesce(text, ''), 41, 120) END AS summary,
 CASE WHEN doc_id % 11 = 0 THEN 'archived' WHEN doc_id % 13 = 0 THEN 'deprecated' WHEN doc_id % 17 = 0 THEN '' ELSE 'active' END AS lifecycle,
 CASE WHEN doc_id % 9 = 0 THEN '' ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS path,
 CASE WHEN doc_id % 6 = 0 THEN source || '/' || lang || '/' || (doc_id - 1) || '.txt#part' ELSE '' END AS path2,
 CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '=' || source END AS keyword,
 CASE WHEN doc_id % 7 = 0 THEN 'missing-' || doc_id WHEN doc_id % 3 = 1 THEN 'c' || (doc_id - 1) ELSE '' END AS depends,
 CASE WHEN doc_id % 5 = 0 THEN 'doc-' || (doc_id - 2) ELSE '' END AS related,
 CASE WHEN doc_id % 8 = 0 THEN 'c' || (doc_id + 1) || CASE WHEN doc_id % 16 = 0 THEN '|label' ELSE '#head' END ELSE '' END AS link, lang, source, n_chars"""
QUESTIONS = """item_id AS question_id, coalesce(text, '') || CASE item_id % 6 WHEN 0 THEN ' payment.retry.maxAttempts config timeout' WHEN 1 THEN ' error failed 排查' WHEN 2 THEN ' RoutePlanner in src/main/RoutePlanner.java class' WHEN 3 THEN ' 架构 design 对比' WHEN 4 THEN ' 用户确认的运维口径说重试间隔' ELSE '' END AS question"""

VIEWS = {"files": ("documents", FILES), "articles": ("documents", ARTICLES), "questions": ("benchmark", QUESTIONS)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return spark.sql(f"SELECT {columns} FROM {{base}}", base=table(spark, sf_dir, base))


def sql_views(*names: str) -> str:
    """WITH entries of the views, for a statement on the input tables."""
    return ", ".join(f"{n} AS (SELECT {VIEWS[n][1]} FROM {VIEWS[n][0]})" for n in names)
