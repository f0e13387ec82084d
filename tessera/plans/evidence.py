"""Citation, evidence and answer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators.adapt import table
from .catalogue import query

#: Answers of three sentences; every second is cited.
ANSWER = "'Code ' || (1000 + doc_id) || ' writes order_' || lang || '_log [[doc-' || doc_id || ']]。Plain text stays。The path /api/' || source || ' serves ' || lang || '_table [→ src/' || doc_id || '.java:L1-L2]；'"
EVIDENCE = "'ARTICLE' AS kind, 'doc-' || doc_id AS target, CASE doc_id % 3 WHEN 0 THEN 'code 999 order_' || lang || '_log' WHEN 1 THEN 'note: Code ' || (1000 + doc_id) || ' writes order_' || lang || '_log' ELSE 'nothing' END AS text"
FILE_EVIDENCE = "'SOURCE_FILE' AS kind, 'src/' || doc_id || '.java' AS target, 'The path /api/' || source || ' serves ' || lang || '_table' AS text"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id AS answer_id", f"{ANSWER} AS answer")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where("doc_id % 10 != 0").selectExpr(*EVIDENCE.split(", ")).unionByName(d.where("doc_id % 4 != 0").selectExpr(*FILE_EVIDENCE.split(", ")))


#: Whole texts with citations of both kinds, labels, line ranges and notes mixed in.
CITED = "coalesce(text, '') || ' [[doc-' || doc_id || '|label]]。' || lang || ' [[→ src/' || source || '.md, note]] and [[' || lang || ']] ; ' || coalesce(text, '') || '[→ src/' || doc_id || '.java:L1-L2]；'"


@query(f"""WITH a AS (SELECT doc_id, regexp_extract_all({CITED}, '[^。；;]*[。；;]|[^。；;]+') AS s FROM documents), c AS (SELECT doc_id, list_filter(list_transform(s, lambda x: trim(regexp_replace(x, '^\\s+', ''))), lambda x: length(x) > 0) AS claims FROM a),
 e AS (SELECT doc_id, unnest(range(len(claims))) AS claim_index, unnest(claims) AS claim FROM c),
 l AS (SELECT doc_id, claim_index, list_concat(list_transform(list_filter(regexp_extract_all(claim, '\\[\\[[^\\]]+\\]\\]'), lambda m: NOT starts_with(m, '[[→')), lambda m: {{'literal': m, 'kind': 'ARTICLE', 'target': trim(string_split(m[3:-3], '|')[1])}}),
  list_transform(regexp_extract_all(claim, '\\[→\\s*[^\\]]+\\]'), lambda m: {{'literal': '[→ ' || trim(string_split(m[3:-2], ',')[1]) || ']', 'kind': 'SOURCE_FILE', 'target': trim(regexp_replace(trim(string_split(m[3:-2], ',')[1]), ':(?:L)?\\d+(?:-(?:L)?\\d+)?$', ''))}})) AS found FROM e),
 x AS (SELECT doc_id, claim_index, unnest(range(len(found))) AS i, unnest(found) AS f FROM l)
SELECT doc_id AS answer_id, claim_index::INT AS claim_index, (row_number() OVER (PARTITION BY doc_id ORDER BY claim_index, i) - 1)::BIGINT AS ordinal, f.literal AS literal, f.kind AS kind, f.target AS target FROM x""")
def citation_literals(spark: SparkSession, sf: str) -> DataFrame:
    """Every citation of whole texts, with its place."""
    return E.ordinals(E.simple_claims(table(spark, sf, "documents").selectExpr("doc_id AS answer_id", f"{CITED} AS answer")))


@query("SELECT doc_id AS answer_id, array_to_string(list_sort(list_distinct([(1000 + doc_id)::VARCHAR, 'order_' || lang || '_log', 'code', 'writes'])), ',') AS facts FROM documents")
def hard_fact_tokens(spark: SparkSession, sf: str) -> DataFrame:
    first = E.simple_claims(answers(spark, sf)).where("claim_index = 0")
    return first.select("answer_id", F.array_join(F.array_sort(E.hard_facts(E.without_citations(F.col("claim")))), ",").alias("facts"))


CHECK_SQL = """checked AS (SELECT doc_id AS answer_id, 0 AS claim_index, CASE WHEN doc_id % 10 = 0 THEN 'NOT_FOUND' WHEN doc_id % 3 = 1 THEN 'VERIFIED' ELSE 'DEMOTED' END AS status FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 4 = 0 THEN 'NOT_FOUND' ELSE 'VERIFIED' END FROM documents)"""


def checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    claims = E.simple_claims(answers(spark, sf))
    return claims, E.validate(E.ordinals(claims, with_claim=True), evidence(spark, sf))


@query(f"WITH {CHECK_SQL} SELECT * FROM checked")
def citation_status(spark: SparkSession, sf: str) -> DataFrame:
    return checked(spark, sf)[1].select("answer_id", "claim_index", "status")


@query(f"WITH {CHECK_SQL} SELECT answer_id, 3 AS claims, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'DEMOTED') AS demoted, 0 AS skipped, count(*) FILTER (status = 'VERIFIED') AS covered, round(count(*) FILTER (status = 'VERIFIED') / 3, 9) AS coverage, 3 - count(*) FILTER (status = 'VERIFIED') AS unsupported, count(*) FILTER (status = 'DEMOTED') > 0 OR count(*) FILTER (status = 'VERIFIED') / 3 < 0.6 AS repair FROM checked GROUP BY 1")
def citation_report(spark: SparkSession, sf: str) -> DataFrame:
    return E.needs_repair(E.report(*checked(spark, sf)))


@query(f"WITH {CHECK_SQL} SELECT answer_id, claim_index, CASE WHEN status = 'VERIFIED' THEN 'VERIFIED' ELSE 'UNSUPPORTED' END AS claim_status FROM checked UNION ALL SELECT doc_id, 1, 'NO_CITATION' FROM documents")
def claim_status(spark: SparkSession, sf: str) -> DataFrame:
    claims, c = checked(spark, sf)
    return E.claim_status(c, claims)


@query(f"WITH {CHECK_SQL}, v AS (SELECT answer_id, min(claim_index) AS place FROM checked WHERE status = 'VERIFIED' GROUP BY 1) SELECT answer_id, 1 AS claim_index, CASE WHEN place = 0 THEN '[[doc-' || answer_id || ']]' ELSE '[→ src/' || answer_id || '.java:L1-L2]' END AS literal FROM v")
def nearest_citation(spark: SparkSession, sf: str) -> DataFrame:
    return E.nearest_citation(*checked(spark, sf))


@query(f"WITH {CHECK_SQL} SELECT round(1 - count(*) FILTER (status = 'VERIFIED') / (3 * (SELECT count(*) FROM documents)), 9) AS unsupported_rate, round(count(*) FILTER (status = 'VERIFIED') / count(*), 9) AS precision, round(count(*) FILTER (status = 'VERIFIED') / (3 * (SELECT count(*) FROM documents)), 9) AS coverage FROM checked")
def answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    claims, c = checked(spark, sf)
    return E.answer_metrics(E.report(claims, c), c)


@query()
def citation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Claims after one round of repair; checked in the tests."""
    claims, c = checked(spark, sf)
    return E.repair_claims(claims, c)


@query()
def claim_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of markdown answers; checked in the tests."""
    return E.claims(answers(spark, sf))


FINDINGS = "event_id AS position, 'fact-' || (event_id % 200) AS fact_key, 's' || (event_id % 40) AS subject, event_type AS value_text, CASE WHEN event_id % 3 = 0 THEN 'ms' ELSE 's' END AS unit, 'claim ' || event_id AS claim, (event_id % 100) / 100.0 AS confidence, 'ev#' || (event_id % 50) AS anchor"
MERGED_SQL = f"f AS (SELECT {FINDINGS} FROM events), merged AS (SELECT fact_key, value_text, unit, max(confidence)::DOUBLE AS confidence, min(position) AS position, arg_min(claim, position) AS claim, arg_min(subject, position) AS subject FROM f WHERE confidence >= 0.55 GROUP BY 1, 2, 3)"


def merged(spark: SparkSession, sf: str) -> DataFrame:
    f = spark.sql(f"SELECT {FINDINGS} FROM {{e}}", e=table(spark, sf, "events"))
    return E.merge_findings(f.withColumn("confidence", F.col("confidence").cast("double")).withColumn("anchors", F.array("anchor")))


@query(f"WITH {MERGED_SQL}, a AS (SELECT fact_key, value_text, unit, anchor, min(position) AS p FROM f WHERE confidence >= 0.55 GROUP BY ALL), l AS (SELECT fact_key, value_text, unit, string_agg(anchor, ',' ORDER BY p) AS anchors FROM a GROUP BY 1, 2, 3) SELECT fact_key, value_text, unit, confidence, anchors, claim FROM merged JOIN l USING (fact_key, value_text, unit)")
def evidence_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("fact_key", "value_text", "unit", "confidence", F.array_join("anchors", ",").alias("anchors"), "claim")


@query(f"WITH {MERGED_SQL} SELECT fact_key, array_to_string(list_sort(list_distinct(list(value_text || '|' || unit))), ',') AS variants FROM merged GROUP BY 1 HAVING count(DISTINCT value_text || '|' || unit) > 1")
def evidence_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return E.conflicts(merged(spark, sf)).select("fact_key", F.array_join("variants", ",").alias("variants"))


@query(f"WITH {MERGED_SQL}, k AS (SELECT fact_key, arg_min(subject, position) AS subject FROM merged GROUP BY 1) SELECT a.subject, a.fact_key, b.fact_key AS other FROM k a JOIN k b USING (subject) WHERE a.fact_key <> b.fact_key")
def complements(spark: SparkSession, sf: str) -> DataFrame:
    return E.complements(merged(spark, sf))


ANCHORS = "CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE 'ev#' || (doc_id % 50) END AS anchor_id, CASE doc_id % 5 WHEN 0 THEN 'ARTICLE' WHEN 1 THEN 'SOURCE_FILE' WHEN 2 THEN 'GRAPH_FACT' WHEN 3 THEN 'CONTRIBUTION' ELSE 'OTHER' END AS source_type, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'd' || doc_id END AS source_id, CASE WHEN doc_id % 6 = 1 THEN '' ELSE 'p' || doc_id END AS path, 5 AS line_start, CASE WHEN doc_id % 8 = 1 THEN 2 ELSE 9 END AS line_end, CASE WHEN doc_id % 15 = 0 THEN '' ELSE 'quote' END AS quote_text, (doc_id % 20) / 20.0 AS retrieval_score"


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"SELECT doc_id, {ANCHORS} FROM {{d}}", d=table(spark, sf, "documents"))


@query(f"WITH a AS (SELECT doc_id, {ANCHORS} FROM documents) SELECT doc_id, CASE WHEN NOT regexp_matches(anchor_id, '^ev#[0-9]+$') THEN 'bad_id' WHEN source_type = 'OTHER' THEN 'bad_type' WHEN source_id = '' THEN 'no_source' WHEN source_type = 'SOURCE_FILE' AND path = '' THEN 'no_path' WHEN source_type = 'SOURCE_FILE' AND line_end < line_start THEN 'bad_lines' WHEN source_type IN ('ARTICLE', 'SOURCE_FILE') AND quote_text = '' THEN 'no_quote' END AS error, sha256(source_type || '|' || source_id || '|' || path || '|' || line_start || '|' || line_end || '|' || quote_text) AS identity FROM a")
def anchor_validation(spark: SparkSession, sf: str) -> DataFrame:
    return E.anchor_error(anchors(spark, sf)).select("doc_id", "error", "identity")


@query(f"WITH {MERGED_SQL}, a AS (SELECT {ANCHORS} FROM documents), u AS (SELECT anchor_id, CASE WHEN source_type = 'ARTICLE' THEN '[[' || source_id || ']]' ELSE '[→ ' || path || ']' END AS literal FROM a WHERE source_type IN ('ARTICLE', 'SOURCE_FILE') AND retrieval_score >= 0.55) SELECT DISTINCT fact_key, anchor AS anchor_id, literal FROM f JOIN u ON anchor = anchor_id WHERE confidence >= 0.55")
def projection_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return E.projection_candidates(merged(spark, sf), anchors(spark, sf))


@query("WITH p AS (SELECT event_id, event_id % 2 = 0 AS a FROM events WHERE event_id % 3 <> 2 OR event_id % 2 = 0) SELECT 'fact-' || e.event_id AS fact_key, coalesce(bool_or(p.a), false) AS covered FROM events e LEFT JOIN p USING (event_id) GROUP BY 1")
def fact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    p = e.where("event_id % 3 != 2 OR event_id % 2 = 0").selectExpr("'fact-' || event_id AS fact_key", "CASE WHEN event_id % 2 = 0 THEN 'ACTIVE' ELSE 'REMOVED' END AS status")
    return E.fact_coverage(e.selectExpr("'fact-' || event_id AS fact_key"), p)


@query("WITH p AS (SELECT DISTINCT 'l' || (user_id % 60) AS literal, user_id % 3 AS k FROM events), n AS (SELECT literal, count(*) AS n FROM p WHERE k <> 2 GROUP BY 1) SELECT event_id AS ordinal, 'l' || (event_id % 100) AS literal, CASE WHEN n.n = 1 THEN 'VERIFIED' ELSE 'DEMOTED' END AS status FROM events LEFT JOIN n ON n.literal = 'l' || (event_id % 100)")
def projection_white_list(spark: SparkSession, sf: str) -> DataFrame:
    """Every event cites a literal; users hold the projections, some literals more than one."""
    e = table(spark, sf, "events")
    p = e.selectExpr("'l' || (user_id % 60) AS literal", "user_id % 3 AS k").distinct().selectExpr("literal", "CASE WHEN k != 2 THEN 'ACTIVE' ELSE 'REMOVED' END AS status")
    return E.white_list(e.selectExpr("event_id AS ordinal", "'l' || (event_id % 100) AS literal"), p).select("ordinal", "literal", "status")


@query("""WITH p AS (SELECT doc_id AS answer_id, unnest([0, 1]) AS ordinal FROM documents) SELECT answer_id, ordinal, 'l' || ordinal AS literal, CASE WHEN ordinal = 0 AND answer_id % 3 <> 2 THEN 'REPLACED' ELSE 'ACTIVE' END AS status FROM p UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 0 THEN 'n' ELSE 'l0' END, CASE WHEN doc_id % 3 = 0 THEN 'ACTIVE' ELSE 'REMOVED' END FROM documents WHERE doc_id % 3 <> 2""")
def projection_repair(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    p = d.selectExpr("doc_id AS answer_id", "explode(array(0, 1)) AS ordinal").selectExpr("answer_id", "ordinal", "'l' || ordinal AS literal", "'ACTIVE' AS status")
    return E.repair_projections(p, d.where("doc_id % 3 != 2").selectExpr("doc_id AS answer_id", "0 AS ordinal", "CASE WHEN doc_id % 3 = 0 THEN 'n' END AS new_literal"))


@query("SELECT doc_id, 'see [[d' || doc_id || ']] and [[x]] but ' AS text FROM documents")
def evidence_projection(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    names = F.create_map(F.lit("ev#1"), F.concat(F.lit("[[d"), F.col("doc_id").cast("string"), F.lit("]]")), F.lit("ev#12"), F.lit("[[x]]"))
    return d.select("doc_id", E.project_text(F.lit("see ev#1 and ev#12 but ev#7"), names).alias("text"))


SCORES = "doc_id % 100 AS task_id, 'k' || doc_id AS key, text AS content, (doc_id % 23) / 20.0 - 0.06 AS score"


@query(f"""WITH h AS (SELECT {SCORES} FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, key) AS n FROM h) SELECT task_id, 'ev#' || n AS anchor_id, substr(content, 1, 200) AS claim, round(CASE WHEN score <= 0 THEN 0.2 WHEN score < 0.55 THEN least(0.95, score + 0.55) WHEN score >= 1 THEN 1.0 ELSE score END, 9)::DOUBLE AS confidence FROM r WHERE n <= 3""")
def research_findings(spark: SparkSession, sf: str) -> DataFrame:
    h = spark.sql(f"SELECT {SCORES} FROM {{d}}", d=table(spark, sf, "documents")).withColumn("score", F.col("score").cast("double"))
    return E.findings(h).select("task_id", "anchor_id", "claim", "confidence")


HITS = "doc_id % 50 AS question_id, CASE doc_id % 4 WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'ARTICLE' WHEN 2 THEN 'GRAPH' ELSE 'CONTRIBUTION' END AS evidence_type, 'k' || (doc_id % 350) AS key, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'dir/' || (doc_id % 300) || '#x' END AS path, doc_id AS rank"


@query(f"""WITH h AS (SELECT {HITS}, CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 3 END AS t FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY t, rank) AS n FROM h), i AS (SELECT *, row_number() OVER (PARTITION BY question_id, CASE WHEN path = '' THEN key ELSE split_part(path, '#', 1) END ORDER BY t, rank) AS m FROM k WHERE n = 1), p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY t, rank)::INT AS place FROM i WHERE m = 1) SELECT question_id, key, place FROM p WHERE place <= 8""")
def answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    return E.answer_sources(spark.sql(f"SELECT {HITS} FROM {{d}}", d=table(spark, sf, "documents"))).select("question_id", "key", "place")


@query("""WITH l AS (SELECT doc_id AS question_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), b AS (SELECT DISTINCT question_id, line, length(line) AS n, contains(lower(line), 'the')::INT + contains(lower(line), 'and')::INT AS hit FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(#|>|!\\[|[|][ :|-]+$|[-*]\\s|\\d+\\.\\s)')), s AS (SELECT question_id, line, n, round(hit * 10.0 + contains(line, '`')::INT * 6 + contains(line, ' = ')::INT * 12 + regexp_matches(line, '[0-9]')::INT * 3 - greatest(0.0, (n - 120) / 24), 6)::DOUBLE AS score FROM b WHERE hit > 0) SELECT question_id, line, score, place FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, n, line)::INT AS place FROM s) WHERE place <= 6""")
def extractive_answer(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.array(F.lit("the"), F.lit("and")).alias("tokens"), F.col("text").alias("content"))
    return E.answer_lines(h).select("question_id", "line", "score", "place")


@query("""WITH f AS (SELECT doc_id % 80 AS question_id, doc_id AS position, CASE WHEN contains(lower(coalesce(text, '')), 'the') THEN 6 ELSE 0 END AS s FROM documents), r AS (SELECT *, max(s) OVER (PARTITION BY question_id) AS best, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, position) AS n FROM f) SELECT question_id, 'cause' AS dimension, position AS finding_id FROM r WHERE best > 0 AND s = best AND n <= 2 OR best = 0 AND n = 1""")
def comparison_pick(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "documents").selectExpr("doc_id % 80 AS question_id", "doc_id AS finding_id", "doc_id AS position", "coalesce(text, '') AS claim")
    return E.comparison_pick(f, [("cause", ["The"], 6)])


RANKED = "user_id AS question_id, 'k' || event_type AS key, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank"


@query(f"WITH r AS (SELECT question_id, key, min(rank) AS rank FROM (SELECT {RANKED} FROM events) GROUP BY 1, 2), e AS (SELECT DISTINCT user_id AS question_id, 'kclick' AS key FROM events UNION SELECT DISTINCT user_id, 'kmissing' FROM events WHERE user_id % 3 = 0), j AS (SELECT e.question_id, count(*) AS n, count(*) FILTER (rank <= 5) AS a, count(*) FILTER (rank <= 10) AS b, min(rank) AS f FROM e LEFT JOIN r USING (question_id, key) GROUP BY 1) SELECT round(sum(a) / sum(n), 9) AS recall_5, round(sum(b) / sum(n), 9) AS recall_10, round(sum(coalesce(1.0 / f, 0)) / count(*), 9)::DOUBLE AS mrr FROM j")
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    r = spark.sql(f"SELECT {RANKED} FROM {{e}}", e=e).groupBy("question_id", "key").agg(F.min("rank").alias("rank"))
    users = e.select(F.col("user_id").alias("question_id")).distinct()
    x = users.select("question_id", F.lit("kclick").alias("key")).unionByName(users.where("question_id % 3 = 0").select("question_id", F.lit("kmissing").alias("key")))
    return E.retrieval_metrics(r, x)
