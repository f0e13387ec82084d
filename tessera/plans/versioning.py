"""Upsert, history, snapshot, export and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import versioning as X
from ..operators.adapt import table
from .catalogue import query

AT = "TIMESTAMP '2024-06-01 00:00:00'"


def _hashed(spark: SparkSession, sf: str, where: str, old: str) -> DataFrame:
    return table(spark, sf, "documents").where(where).selectExpr("'doc' AS type", "CAST(doc_id AS STRING) AS id", "'f' || doc_id AS path", f"sha2(CASE WHEN {old} THEN 'old' ELSE text END, 256) AS hash")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey <> 0")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    delta = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey AS id", "'new' AS status").unionByName(o.where("o_orderkey % 50 = 0 AND o_orderkey != 0").selectExpr("-o_orderkey AS id", "'added' AS status"))
    return X.upsert(o.selectExpr("o_orderkey AS id", "o_orderstatus AS status"), delta, ["id"])


HISTORY = "o_custkey AS article_key, o_orderkey AS id, o_orderdate AS captured_at, o_orderpriority AS content"


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*HISTORY.split(", "))


@query(f"SELECT article_key, id, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY article_key ORDER BY captured_at DESC, id DESC) AS n FROM (SELECT {HISTORY} FROM orders)) WHERE n <= 3")
def history_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return X.last_n(history(spark, sf), "article_key", 3).select("article_key", "id", "n")


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) SELECT user_id, event_id FROM r WHERE n = 1")
def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    return X.latest(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query(f"WITH h AS (SELECT {HISTORY} FROM orders), l AS (SELECT article_key, arg_max(content, (captured_at, id)) AS content FROM h GROUP BY 1), f AS (SELECT article_key, arg_min(content, (captured_at, id)) AS content FROM h GROUP BY 1) SELECT article_key, CASE WHEN article_key % 4 = 0 THEN f.content ELSE l.content END AS content FROM l JOIN f USING (article_key)")
def rollback(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    order = F.struct("captured_at", "id")
    a = h.groupBy("article_key").agg(F.max_by("content", order).alias("content"))
    first = h.groupBy("article_key").agg(F.min_by("id", order).alias("snapshot_id"))
    wrong = first.where("article_key % 4 = 1").select("article_key", (F.col("snapshot_id") + 10_000_000).alias("snapshot_id"))
    return X.rollback(a, h, first.where("article_key % 4 = 0").unionByName(wrong), F.expr(AT))[0].select("article_key", "content")


@query("SELECT 'doc' AS type, doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'ADDED' WHEN doc_id % 7 = 0 THEN 'REMOVED' ELSE 'MODIFIED' END AS change FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0) OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 = 0)")
def repo_diff(spark: SparkSession, sf: str) -> DataFrame:
    return X.diff(_hashed(spark, sf, "doc_id % 5 != 0", "doc_id % 3 = 0"), _hashed(spark, sf, "doc_id % 7 != 0", "false"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Three types of entities."""
    return X.repo_items({"article": (table(spark, sf, "documents"), "doc_id"), "page": (table(spark, sf, "pages"), "page_id"), "order": (table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")})


@query("SELECT 'article' AS type, doc_id::VARCHAR AS id, text AS content FROM documents UNION ALL SELECT 'page', page_id::VARCHAR, html FROM pages UNION ALL SELECT 'order', o_orderkey::VARCHAR, o_orderstatus FROM orders")
def repo_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    field = lambda n: F.get_json_object("payload", f"$.{n}")
    return _items(spark, sf).select("type", "id", F.when(F.col("type") == "article", field("text")).when(F.col("type") == "page", field("html")).otherwise(field("o_orderstatus")).alias("content"))


@query("SELECT page_id, url, html FROM pages")
def repo_restore(spark: SparkSession, sf: str) -> DataFrame:
    return X.restore(_items(spark, sf), "page", "page_id long, url string, html string")


@query("SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'DELETE' WHEN doc_id % 5 = 0 OR doc_id % 3 = 0 THEN 'WRITE' ELSE 'SKIP' END AS action FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)")
def vault_actions(spark: SparkSession, sf: str) -> DataFrame:
    return X.export_actions(_hashed(spark, sf, "doc_id % 7 != 0", "false"), _hashed(spark, sf, "doc_id % 5 != 0", "doc_id % 3 = 0"))


@query("SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 2 <> 0 THEN 'SKIP' WHEN doc_id % 3 = 0 THEN 'CONFLICT' ELSE 'SYNC' END AS action FROM documents")
def vault_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    h = lambda test: d.selectExpr("'f' || doc_id AS path", f"CASE WHEN {test} THEN 'x' ELSE text END || doc_id AS hash")
    return X.import_actions(h("doc_id % 2 = 0"), h("false"), d.selectExpr("'f' || doc_id AS path", "CASE WHEN doc_id % 6 = 0 THEN 'y' ELSE text END || doc_id AS hash"))


REFS = "CASE doc_id % 4 WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 't' || (doc_id % 50) WHEN 2 THEN 'file-' || doc_id ELSE 'none-' || doc_id END AS ref, doc_id % 4 AS source_id"


@query("WITH a AS (SELECT 'doc-' || doc_id AS article_key, 't' || (doc_id % 50) AS concept_id, doc_id % 4 AS source_id, doc_id FROM documents), r AS (SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 't' || (doc_id % 50) WHEN 2 THEN 'file-' || doc_id ELSE 'none-' || doc_id END AS ref, doc_id % 4 AS source_id FROM documents), s AS (SELECT r.ref, r.source_id, coalesce((SELECT max(k.article_key) FROM a k WHERE k.article_key = r.ref), (SELECT arg_max(c.article_key, (c.doc_id, c.article_key)) FROM a c WHERE c.concept_id = r.ref AND c.source_id = r.source_id), (SELECT arg_max(c.article_key, (c.doc_id, c.article_key)) FROM a c WHERE c.concept_id = r.ref)) AS found FROM r) SELECT ref, CASE WHEN found IS NOT NULL THEN 'ARTICLE' WHEN ref LIKE 'file-%' THEN 'SOURCE_FILE' ELSE 'NOT_FOUND' END AS kind, coalesce(found, CASE WHEN ref LIKE 'file-%' THEN substr(ref, 6) END) AS found FROM s")
def knowledge_lookup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    a = d.selectExpr("'doc-' || doc_id AS article_key", "'t' || (doc_id % 50) AS concept_id", "doc_id % 4 AS source_id", "doc_id AS compiled_at")
    refs = d.selectExpr("CASE doc_id % 4 WHEN 0 THEN 'doc-' || doc_id WHEN 1 THEN 't' || (doc_id % 50) WHEN 2 THEN 'file-' || doc_id ELSE 'none-' || doc_id END AS ref", "doc_id % 4 AS source_id").distinct()
    files = d.selectExpr("doc_id AS id", "'file-' || doc_id AS file_path", "'rel-' || doc_id AS relative_path")
    return X.lookup(refs, a, files)


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def bridge_join(spark: SparkSession, sf: str) -> DataFrame:
    """Article to file bridge: two dimensions joined to the fact; Spark picks the strategy by size."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part, supplier = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return line.join(part, "l_partkey").join(supplier, "l_suppkey").select("l_orderkey", "l_linenumber", "p_name", "s_name")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS step FROM events""")
def job_step_numbers(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("step"))


@query("SELECT doc_id, (source = 'src1' OR lang = 'src1' OR lang = 'en')::INT AS has_en, 3::INT AS appended, ((lang <> source)::INT + ('en' <> source)::INT)::INT AS left_over FROM documents")
def json_array_edit(spark: SparkSession, sf: str) -> DataFrame:
    """Membership, append and removal by key in JSON arrays that each row holds."""
    kind = "array<struct<`from`:string,note:string>>"
    d = table(spark, sf, "documents").select("doc_id", "source", F.to_json(F.array(F.struct(F.col("source").alias("from"), F.col("lang").alias("note")), F.struct(F.col("lang").alias("from"), F.col("source").alias("note")))).alias("j"))
    has = T.json_has(F.col("j"), kind, "from", F.lit("en")) | T.json_has(F.col("j"), kind, "from", F.lit("src1"))
    more = T.json_append(F.col("j"), F.struct(F.lit("en").alias("from"), F.lit("new").alias("note")))
    size = lambda c: F.size(F.from_json(c, kind))
    return d.select("doc_id", has.cast("int").alias("has_en"), size(more).alias("appended"), size(T.json_remove(more, "from", F.col("source"))).alias("left_over"))


@query("SELECT vec_id, len(embedding)::INT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6)::DOUBLE AS total FROM embeddings")
def vector_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as literals and read back."""
    v = table(spark, sf, "embeddings").select("vec_id", T.vector_of(T.vector_literal(F.transform("embedding", lambda x: x.cast("double")))).alias("v"))
    return v.select("vec_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL SELECT o_orderkey, 0, 0.0 FROM orders WHERE o_orderpriority = '1-URGENT'")
def chunk_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of some owners replaced by new ones."""
    from ..operators import compile as C

    old = table(spark, sf, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS LONG) AS l_linenumber", "CAST(l_quantity AS DOUBLE) AS l_quantity")
    new = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").selectExpr("o_orderkey AS l_orderkey", "CAST(0 AS LONG) AS l_linenumber", "CAST(0 AS DOUBLE) AS l_quantity")
    return C.replace_chunks(old, new, "l_orderkey")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, 'import' AS snapshot_reason, strftime(TIMESTAMP '2024-06-01 00:00:00', '%Y-%m-%d') AS captured FROM orders WHERE o_orderstatus = 'F'")
def history_capture(spark: SparkSession, sf: str) -> DataFrame:
    """The history rows that an upsert appends."""
    delta = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS id", "o_orderstatus AS status")
    return X.history_rows(delta, "import", F.expr(AT)).select("id", "status", "snapshot_reason", F.date_format("captured_at", "yyyy-MM-dd").alias("captured"))


@query("SELECT doc_id, concat_ws(chr(10), lang, source, coalesce(text, ''), '{}') AS search_text, 'c' || doc_id || ' ' || lang || ' ' || source || ' ' || lang AS refkey_text FROM documents")
def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The search columns that are filled at write time."""
    a = table(spark, sf, "documents").selectExpr("doc_id", "lang AS title", "source AS summary", "coalesce(text, '') AS content", "'{}' AS metadata", "'c' || doc_id AS concept_id", "array(source, lang) AS keywords")
    return X.with_search_text(a).select("doc_id", "search_text", "refkey_text")


@query("SELECT doc_id, lang AS title, '' AS missing, coalesce(text, '') AS body FROM documents")
def metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a JSON column, blank where there is none."""
    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(F.col("lang").alias("title"), F.struct("text").alias("inner"))).alias("j"))
    return d.select("doc_id", T.json_field(F.col("j"), "title").alias("title"), T.json_field(F.col("j"), "nothing").alias("missing"), T.json_field(F.col("j"), "inner.text").alias("body"))
