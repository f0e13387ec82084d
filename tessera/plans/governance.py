"""Governance, graph and job queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import governance as G
from ..operators import graph
from ..operators.adapt import sql_views, table, view
from .catalogue import query
from .retrieval import PAIRS_SQL, pairs

NOW = "TIMESTAMP '2024-06-01 00:00:00'"
STATUS = "CASE WHEN quality = 1 THEN 'passed' WHEN quality = 0 AND toxic = 1 THEN 'needs_human_review' ELSE 'pending' END"
LISTS = """list_filter([path, path2], lambda p: p <> '') AS source_paths, list_filter([keyword], lambda k: k <> '') AS keywords, list_filter([depends], lambda d: d <> '') AS depends_on, list_filter([related], lambda r: r <> '') AS related_to"""
FULL = f"{sql_views('articles', 'files')}, full_articles AS (SELECT a.*, {LISTS}, {STATUS} AS review_status FROM articles a LEFT JOIN labels USING (doc_id))"
FILE_PATHS = "known AS (SELECT DISTINCT source || '/' || lang || '/' || id || '.txt' AS path FROM files)"


def articles(spark: SparkSession, sf: str) -> DataFrame:
    full = view(spark, sf, "articles").join(table(spark, sf, "labels"), "doc_id", "left")
    some = lambda *c: F.filter(F.array(*c), lambda x: x != "")
    link = F.when(F.col("link") != "", F.concat(F.lit("see [["), "link", F.lit("]] "), "title")).otherwise(F.col("title"))
    return full.select("*", some("path", "path2").alias("source_paths"), some("keyword").alias("keywords"), some("depends").alias("depends_on"), some("related").alias("related_to"), F.expr(STATUS).alias("review_status"), link.alias("linked"))


def known_files(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").select(F.expr("source || '/' || lang || '/' || id || '.txt'").alias("path"))


NAMED = "named AS (SELECT DISTINCT trim(string_split(p, '#')[1]) AS path FROM (SELECT unnest(source_paths) AS p FROM full_articles))"


@query(f"WITH {FULL}, {FILE_PATHS}, {NAMED} SELECT count(*) AS total, count(named.path) AS covered, count(named.path) / count(*) AS ratio FROM known LEFT JOIN named USING (path)")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return G.coverage(known_files(spark, sf), articles(spark, sf))


@query(f"WITH {FULL}, {FILE_PATHS}, {NAMED} SELECT path FROM known WHERE path NOT IN (SELECT path FROM named)")
def omissions(spark: SparkSession, sf: str) -> DataFrame:
    return G.omitted_paths(known_files(spark, sf), articles(spark, sf))


@query(f"WITH {FULL}, {PAIRS_SQL} SELECT (SELECT count(*) FROM full_articles) AS articles, (SELECT count(*) FROM full_articles WHERE review_status <> 'passed') AS not_passed, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM pairs WHERE turn >= 2) AS contributions, (SELECT count(*) FROM pairs WHERE turn < 2) AS pending")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    return G.status_counts(articles(spark, sf), view(spark, sf, "files"), p.where("turn >= 2"), p.where("turn < 2"))


@query(f"""WITH {FULL}, s AS (SELECT count(*) AS total, count(*) FILTER (review_status = 'passed') AS passed, count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'needs_human_review') AS needs_human, count(*) FILTER (len(source_paths) > 0) AS grounded, count(*) FILTER (len(keywords) > 0) AS referential FROM full_articles)
SELECT *, floor(passed * 100.0 / total * 100 + 0.5) / 100 AS passed_rate, floor(grounded * 100.0 / total * 100 + 0.5) / 100 AS grounded_rate, floor(referential * 100.0 / total * 100 + 0.5) / 100 AS referential_rate FROM s""")
def quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return G.quality(articles(spark, sf))


@query("WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT event_type AS metric, value, ts, event_id FROM events, n WHERE ts > now - INTERVAL 7 DAY) SELECT metric, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS change FROM r GROUP BY metric")
def quality_trend(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    now = F.lit(e.agg(F.max("ts")).first()[0])
    return G.quality_trend(e.select(F.col("event_type").alias("metric"), "value", F.col("ts").alias("measured_at"), F.col("event_id").alias("id")), now, 7)


@query(f"WITH {FULL} SELECT CASE WHEN lifecycle = '' THEN 'active' ELSE lifecycle END AS lifecycle, count(*) AS n FROM full_articles GROUP BY 1")
def lifecycle_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return G.lifecycle_distribution(articles(spark, sf))


@query(f"WITH {FULL} SELECT concept_id, CASE WHEN doc_id % 4 = 1 THEN 'archived' ELSE lifecycle END AS lifecycle, doc_id % 4 = 1 AS noted FROM full_articles")
def lifecycle_transition(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf).withColumn("metadata", F.lit(None).cast("string"))
    return G.transition(a, "archived", "unused", a.where("doc_id % 4 = 1")).select("concept_id", "lifecycle", F.col("metadata").isNotNull().alias("noted"))


LINT_SQL = """lint AS (SELECT concept_id, 'consistency' AS dimension, '标题重复，可能存在概念重叠' AS message, true AS fixable FROM full_articles WHERE title IN (SELECT title FROM full_articles GROUP BY title HAVING count(*) > 1)
 UNION ALL SELECT concept_id, 'gaps', '缺少 summary', true FROM full_articles WHERE trim(summary) = ''
 UNION ALL SELECT concept_id, 'freshness', '生命周期不是 active', false FROM full_articles WHERE lifecycle <> 'active'
 UNION ALL SELECT concept_id, 'grounding', '缺少 source_paths', false FROM full_articles WHERE len(source_paths) = 0
 UNION ALL SELECT concept_id, 'referential', '缺少 referential_keywords', true FROM full_articles WHERE len(keywords) = 0
 UNION ALL SELECT concept_id, 'consistency', '文章仍处于 needs_human_review', false FROM full_articles WHERE review_status = 'needs_human_review'
 UNION ALL SELECT concept_id, 'propagation', '依赖概念缺失: ' || depends, false FROM full_articles WHERE depends <> '' AND depends NOT IN (SELECT concept_id FROM full_articles))"""


@query(f"WITH {FULL}, {LINT_SQL} SELECT * FROM lint")
def lint_issues(spark: SparkSession, sf: str) -> DataFrame:
    return G.lint(articles(spark, sf))


@query(f"WITH {FULL}, {LINT_SQL} SELECT concept_id, count(*) FILTER (fixable) AS fixable, count(*) FILTER (NOT fixable) AS skipped, coalesce(array_to_string(list_sort(list_distinct(list(dimension) FILTER (fixable))), ','), '') AS dimensions FROM lint GROUP BY 1")
def lint_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return G.lint_fixes(G.lint(articles(spark, sf)))


@query(f"WITH {FULL} SELECT title, count(*) AS n, min(concept_id) AS first_concept FROM full_articles GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return G.duplicate_titles(articles(spark, sf))


PENDING_SQL = f"{PAIRS_SQL}, pending AS (SELECT query_id, conv_id, turn, question_text AS question, answer_text AS answer, {NOW} + INTERVAL 1 HOUR * (conv_id % 49 - 24) AS expires_at FROM pairs)"


def pending(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("query_id", "conv_id", "turn", F.col("question_text").alias("question"), F.col("answer_text").alias("answer"), F.expr(f"{NOW} + make_interval(0, 0, 0, 0, CAST(conv_id % 49 - 24 AS INT))").alias("expires_at"), F.array().cast("array<string>").alias("corrections"))


@query(f"WITH {PENDING_SQL} SELECT query_id, question, answer, 'pending_query' AS kind FROM pending WHERE expires_at >= {NOW}")
def pending_active(spark: SparkSession, sf: str) -> DataFrame:
    return G.inspection(pending(spark, sf), F.expr(NOW))


@query(f"WITH {PENDING_SQL} SELECT query_id, CASE WHEN conv_id % 3 = 0 THEN 'stays' ELSE 'contribution' END AS state, (conv_id % 3 = 0 AND turn = 0)::INT AS n_corrections FROM pending WHERE conv_id % 3 <> 2")
def feedback_confirm(spark: SparkSession, sf: str) -> DataFrame:
    p = pending(spark, sf)
    d = p.where("conv_id % 3 != 0 OR turn = 0").select("query_id", F.expr("CASE conv_id % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'confirm' ELSE 'discard' END").alias("action"), F.lit("fixed").alias("correction"))
    stay, moved = G.confirm(p, d)
    each = lambda df, state: df.select("query_id", F.lit(state).alias("state"), F.size("corrections").alias("n_corrections"))
    return each(stay, "stays").unionByName(each(moved, "contribution"))


@query(f"WITH {FULL} SELECT article_key, title FROM full_articles WHERE lifecycle = 'active' AND (contains(lower(title), 'the') OR contains(lower(summary), 'the') OR contains(lower(content), 'the') OR contains(lower(path), 'the') OR contains(lower(path2), 'the'))")
def article_browse(spark: SparkSession, sf: str) -> DataFrame:
    return G.browse(articles(spark, sf), "The", "active").select("article_key", "title")


SEVERITY_SQL = "list_filter([CASE WHEN doc_id % 2 = 0 THEN 'LOW' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'HIGH' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'medium' ELSE '' END], lambda s: s <> '')"


@query(f"""WITH r AS (SELECT doc_id, doc_id % 7 = 0 AS passed, {SEVERITY_SQL} AS s FROM documents) SELECT doc_id, CASE WHEN passed THEN 'accepted' WHEN list_contains(s, 'HIGH') THEN 'needs_human_review' ELSE 'accepted' END AS route, CASE WHEN NOT passed AND len(s) > 0 THEN 'fixable' WHEN passed OR NOT list_contains(s, 'HIGH') THEN 'accepted' ELSE 'needs_human_review' END AS first_route FROM r""")
def review_route(spark: SparkSession, sf: str) -> DataFrame:
    s = F.filter(F.array(*(F.expr(f"CASE WHEN doc_id % {n} = 0 THEN '{w}' ELSE '' END") for n, w in ((2, "LOW"), (3, "HIGH"), (5, "medium")))), lambda x: x != "")
    r = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7 == 0).alias("passed"), s.alias("severities"))
    late = G.review_route(r, attempt=1).select("doc_id", "route")
    return late.join(G.review_route(r).select("doc_id", F.col("route").alias("first_route")), "doc_id")


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---\nsources:\nreview_status: pending\n---\n# T\n' WHEN 1 THEN 'TODO ' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(text, '') END AS article, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'src' END AS src FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(article) = '' THEN 'HIGH:EMPTY_ARTICLE' ELSE '' END, CASE WHEN NOT contains(article, 'sources:') THEN 'HIGH:MISSING_SOURCES' ELSE '' END, CASE WHEN NOT contains(article, 'review_status:') THEN 'MEDIUM:MISSING_REVIEW_STATUS' ELSE '' END, CASE WHEN contains(article, 'TODO') OR contains(article, 'TBD') THEN 'HIGH:PLACEHOLDER_CONTENT' ELSE '' END, CASE WHEN NOT contains(article, '# ') THEN 'MEDIUM:MISSING_TITLE' ELSE '' END, CASE WHEN trim(src) = '' THEN 'HIGH:EMPTY_SOURCES' ELSE '' END], lambda x: x <> ''), ',') AS issues FROM a""")
def review_issues(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").selectExpr("doc_id", r"CASE doc_id % 3 WHEN 0 THEN '---\nsources:\nreview_status: pending\n---\n# T\n' WHEN 1 THEN 'TODO ' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '' ELSE coalesce(text, '') END AS article", "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'src' END AS src")
    return a.select("doc_id", F.array_join(G.review_issues(F.col("article"), F.col("src")), ",").alias("issues"))


@query("SELECT doc_id, doc_id % 2 = 0 AND doc_id % 3 <> 0 AND (doc_id % 10) / 10.0 >= 0.6 AS cacheable FROM documents")
def answer_cacheable(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN 'SUCCESS' ELSE 'MODEL_FAILURE' END AS outcome", "'x' AS answer", "1 AS evidence", "'PASSED' AS review", "1 AS citations", "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS demoted", "0 AS unsupported", "0 AS mismatch", "(doc_id % 10) / 10 AS coverage")
    return G.cacheable(a).select("doc_id", "cacheable")


JOBS = f"event_id AS job_id, event_id AS task_id, CASE event_id % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, ts AS requested_at, ts AS updated_at"
MINUTES = {"lease_until": "event_id % 41 - 10", "heartbeat_at": "-(event_id % 13)", "progress_at": "-(event_id % 17)"}


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    times = ", ".join(f"{NOW} + make_interval(0, 0, 0, 0, 0, CAST({m} AS INT)) AS {c}" for c, m in MINUTES.items())
    return spark.sql(f"SELECT {JOBS}, {times} FROM {{e}}", e=table(spark, sf, "events"))


JOBS_SQL = f"jobs AS (SELECT {JOBS}, " + ", ".join(f"{NOW} + INTERVAL 1 MINUTE * ({m}) AS {c}" for c, m in MINUTES.items()) + " FROM events)"


@query(f"WITH {JOBS_SQL} SELECT job_id, CASE WHEN status = 'RUNNING' AND (lease_until < {NOW} OR heartbeat_at < {NOW} - INTERVAL 10 MINUTE OR progress_at < {NOW} - INTERVAL 10 MINUTE) THEN 'STALLED' ELSE status END AS derived_status FROM jobs")
def job_status(spark: SparkSession, sf: str) -> DataFrame:
    return G.job_status(jobs(spark, sf), F.expr(NOW)).select("job_id", "derived_status")


@query(f"WITH {JOBS_SQL} SELECT job_id FROM jobs WHERE status = 'RUNNING' AND lease_until < {NOW}")
def expired_leases(spark: SparkSession, sf: str) -> DataFrame:
    return G.expired_leases(jobs(spark, sf), F.expr(NOW)).select("job_id")


@query(f"WITH {JOBS_SQL} SELECT job_id FROM jobs WHERE status = 'QUEUED' ORDER BY requested_at, job_id LIMIT 1")
def next_job(spark: SparkSession, sf: str) -> DataFrame:
    return G.next_job(jobs(spark, sf)).select("job_id")


BOARD_SQL = f"{JOBS_SQL}, board AS (SELECT CASE WHEN task_id % 5 = 0 THEN 'sync' ELSE 'job' END AS kind, task_id, status, updated_at FROM jobs)"


@query(f"WITH {BOARD_SQL} SELECT kind, task_id, status FROM board ORDER BY updated_at DESC, kind, task_id LIMIT 20")
def task_board(spark: SparkSession, sf: str) -> DataFrame:
    j = jobs(spark, sf)
    return G.task_board(j.where("task_id % 5 = 0"), j.where("task_id % 5 != 0"))[0].select("kind", "task_id", "status")


@query(f"WITH {BOARD_SQL} SELECT status, count(*) AS n FROM board GROUP BY 1")
def task_summary(spark: SparkSession, sf: str) -> DataFrame:
    j = jobs(spark, sf)
    return G.task_board(j.where("task_id % 5 = 0"), j.where("task_id % 5 != 0"))[1]


# the wiki link stands in front of the title
EDGE_SQL = f"""{FULL}, refs AS (SELECT source_id, article_key, depends AS ref, 'depends_on' AS relation FROM full_articles WHERE depends <> '' UNION ALL SELECT source_id, article_key, related, 'related' FROM full_articles WHERE related <> '' UNION ALL SELECT source_id, article_key, string_split(string_split(link, '|')[1], '#')[1], 'wiki_link' FROM full_articles WHERE link <> ''),
 names AS (SELECT source_id, concept_id AS ref, article_key AS target FROM full_articles UNION SELECT source_id, article_key, article_key FROM full_articles),
 found AS (SELECT DISTINCT target AS upstream, article_key AS downstream, relation FROM refs JOIN names USING (source_id, ref) WHERE target <> article_key),
 edges AS (SELECT * FROM found UNION SELECT downstream, upstream, relation FROM found WHERE relation = 'related')"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf).select("article_key", "concept_id", "source_id", F.col("doc_id").alias("ordinal"), "depends_on", F.col("related_to").alias("related"), F.col("linked").alias("content"))
    return graph.edges(a)


@query(f"WITH {EDGE_SQL} SELECT * FROM edges")
def dependency_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@query(f"WITH RECURSIVE {EDGE_SQL}, reach(root, node, depth, relation) AS (SELECT DISTINCT upstream, upstream, 0, '' FROM edges UNION SELECT root, downstream, depth + 1, edges.relation FROM reach JOIN edges ON node = upstream WHERE depth < 64) SELECT root, node, min(depth)::INT AS depth, arg_min(relation, (depth, relation)) AS relation FROM reach GROUP BY root, node HAVING min(depth) > 0 AND root <> node")
def impact_bfs(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return graph.impact(e, e.select(F.col("upstream").alias("root")))


@query()
def impact_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same as impact_bfs, whose SQL needs a bound on the depth because of cycles; checked in the tests by brute force."""
    return impact_bfs(spark, sf)


@query(f"WITH {EDGE_SQL}, links AS (SELECT article_key, string_split(string_split(link, '|')[1], '#')[1] AS target FROM full_articles WHERE link <> '') SELECT count(*) AS links, count(c.concept_id) AS resolved, count(*) - count(c.concept_id) AS unresolved, count(DISTINCT l.article_key) AS articles FROM links l LEFT JOIN (SELECT DISTINCT concept_id FROM full_articles) c ON target = concept_id")
def link_totals(spark: SparkSession, sf: str) -> DataFrame:
    a = articles(spark, sf).select("article_key", "concept_id", F.concat(F.lit("t "), "concept_id").alias("title"), F.col("linked").alias("content"))
    return graph.link_totals(graph.link_targets(a))


ENTITIES = "p_partkey AS entity_id, p_name AS canonical_name, split_part(p_name, ' ', 2) AS simple_name, p_size % 5 = 0 AS unresolved"
FACTS = "l_partkey AS entity_id, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'mode' ELSE 'flag' END AS predicate, l_returnflag AS value, l_discount AS confidence, l_tax > 0.06 AS tombstoned, CAST(CASE WHEN l_linestatus = 'F' AND l_linenumber > 3 THEN 'x' END AS VARCHAR(10)) AS superseded_by"
BLOCK_SQL = f"""entities AS (SELECT {ENTITIES} FROM part), facts AS (SELECT {FACTS} FROM lineitem WHERE l_linenumber < 3), rels AS (SELECT {FACTS}, l_suppkey AS dst FROM lineitem WHERE l_linenumber >= 3),
 f AS (SELECT entity_id, string_agg('；' || predicate || '=' || value, '' ORDER BY n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, id) AS n FROM facts WHERE NOT tombstoned AND superseded_by IS NULL) WHERE n <= 6 GROUP BY 1),
 r AS (SELECT entity_id, string_agg('；supplies->' || dst, '' ORDER BY n) AS t FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, id) AS n FROM rels WHERE NOT tombstoned AND superseded_by IS NULL) WHERE n <= 6 GROUP BY 1),
 blocks AS (SELECT e.entity_id, '实体=' || canonical_name || coalesce(f.t, '') || coalesce(r.t, '') AS block FROM entities e LEFT JOIN f USING (entity_id) LEFT JOIN r USING (entity_id))"""


def blocks(spark: SparkSession, sf: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The entities and their blocks; only: entity_id of those that are wanted, if not all are."""
    e = spark.sql(f"SELECT {ENTITIES} FROM {{p}}", p=table(spark, sf, "part"))
    lines = spark.sql(f"SELECT {FACTS}, l_linenumber, 'supplies' AS edge_type, CAST(l_suppkey AS STRING) AS dst FROM {{l}}", l=table(spark, sf, "lineitem"))
    if only is not None:
        e, lines = e.join(only, "entity_id", "left_semi"), lines.join(only, "entity_id", "left_semi")
    return e, graph.facts_block(e, lines.where("l_linenumber < 3"), lines.where("l_linenumber >= 3"))


@query(f"WITH {BLOCK_SQL} SELECT * FROM blocks")
def facts_block(spark: SparkSession, sf: str) -> DataFrame:
    return blocks(spark, sf)[1]


SEARCH = "p_partkey AS question_id, CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) ELSE 'mode ' || p_brand END AS question"


@query(f"""WITH {BLOCK_SQL}, tok AS (SELECT DISTINCT question_id, token FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9=_-]{{2,}}')) AS token FROM (SELECT {SEARCH} FROM part))),
 m AS (SELECT DISTINCT question_id, entity_id, simple_name FROM tok, entities WHERE contains(lower(simple_name), token) OR contains(lower(canonical_name), token)),
 first AS (SELECT question_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY simple_name, entity_id) AS n FROM m) WHERE n <= 10),
 s AS (SELECT question_id, entity_id, unresolved, sum(CASE WHEN contains(lower(simple_name), token) THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(canonical_name), token) THEN 2.5 ELSE 0 END + CASE WHEN contains(lower(block), token) THEN 1.0 ELSE 0 END) AS s FROM first JOIN entities USING (entity_id) JOIN blocks USING (entity_id) JOIN tok USING (question_id) GROUP BY ALL),
 w AS (SELECT question_id, entity_id, round(CASE WHEN unresolved THEN s * 0.6 ELSE s END, 9)::DOUBLE AS score FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, entity_id)::INT AS rank FROM w WHERE score > 0) WHERE rank <= 5""")
def entity_search(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    q, e = spark.sql(f"SELECT {SEARCH} FROM {{p}}", p=p), spark.sql(f"SELECT {ENTITIES} FROM {{p}}", p=p)
    return graph.entity_search(q, e, lambda only: blocks(spark, sf, only)[1])


@query(f"""WITH {EDGE_SQL}, d AS (SELECT DISTINCT downstream, upstream FROM edges WHERE relation = 'depends_on'), n AS (SELECT downstream, count(*) AS marked, count(*) FILTER (NOT upstream LIKE '%0') AS kept FROM d GROUP BY 1)
SELECT article_key, coalesce(marked, 0)::INT AS marked, coalesce(kept, 0)::INT AS kept FROM full_articles LEFT JOIN n ON article_key = downstream""")
def correction_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Articles marked by corrections of what they depend on, and what is left once some are cleared."""
    e = edges(spark, sf).where("relation = 'depends_on'").select(F.col("downstream").alias("concept_id"), "upstream", F.lit("changed").alias("note")).distinct()
    a = view(spark, sf, "articles").select(F.col("article_key").alias("concept_id"), F.lit(None).cast("string").alias("corrections"))
    marked = graph.mark_downstream(a, e)
    left = graph.clear_upstream(marked, e.where("upstream LIKE '%0'"))
    n = lambda df, name: df.select("concept_id", F.when(F.col("corrections").isNull(), 0).otherwise(F.size(F.from_json("corrections", graph.CORRECTION))).alias(name))
    return n(marked, "marked").join(n(left, "kept"), "concept_id").withColumnRenamed("concept_id", "article_key")


@query("""WITH a AS (SELECT doc_id, 'c' || doc_id AS concept_id, 'Topic ' || doc_id AS title FROM documents) SELECT 'c' || a.doc_id AS article_key, 'see [[' || CASE WHEN t.doc_id IS NULL THEN 'topic  ' || (a.doc_id + 1) ELSE t.concept_id END || '|label]], [[c' || a.doc_id || '#top]] and [[nowhere ' || a.doc_id || ']].' AS content, (t.doc_id IS NOT NULL)::BIGINT AS fixed, CASE WHEN t.doc_id IS NULL THEN 'nowhere ' || a.doc_id || ',topic  ' || (a.doc_id + 1) ELSE 'nowhere ' || a.doc_id END AS unresolved FROM a LEFT JOIN a t ON t.doc_id = a.doc_id + 1""")
def link_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Wiki links by title become links by concept id."""
    n = F.col("doc_id").cast("string")
    content = F.concat(F.lit("see [[topic  "), (F.col("doc_id") + 1).cast("string"), F.lit("|label]], [[c"), n, F.lit("#top]] and [[nowhere "), n, F.lit("]]."))
    a = table(spark, sf, "documents").select(F.concat(F.lit("c"), n).alias("article_key"), F.concat(F.lit("c"), n).alias("concept_id"), F.concat(F.lit("Topic "), n).alias("title"), content.alias("content"))
    return graph.repair_links(a).select("article_key", "content", "fixed", F.array_join("unresolved", ",").alias("unresolved"))


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) <> '' AND contains(text, 'sources:') AND contains(text, 'review_status:') AND contains(text, '# ') AND NOT contains(text, 'TODO') AND NOT contains(text, 'TBD') OR length(source) % 2 = 0 THEN 'accepted' ELSE 'needs_human_review' END AS route FROM documents""")
def review_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """A round of review, a fixer that succeeds for some articles only, and a last review."""
    a = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("article"), F.col("source").alias("sources"))
    body = F.when(F.length("sources") % 2 == 0, F.concat(F.lit("sources:\nreview_status: pending\n# "), F.col("doc_id").cast("string"))).otherwise("TODO")
    return G.review_loop(a, lambda rows: rows.withColumn("article", body)).select("doc_id", "route")
