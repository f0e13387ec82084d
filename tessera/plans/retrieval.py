"""Retrieval queries over benchmark texts as questions and documents as articles and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import answers as A
from ..operators import compile as C
from ..operators import graph
from ..operators import retrieval as R
from ..operators.adapt import sql_views, table, view
from ..operators.common import cut
from .catalogue import query


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


SQL_GRAMS = "list_filter(flatten(list_transform(regexp_extract_all(question, '\\p{Han}{2,}'), lambda r: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n)))))), lambda t: NOT regexp_matches(t, '[" + V.STOP_CHARS + "]'))"
#: Camel-case parts without a look-ahead, which suits words that hold no run of capitals, as all here.
SQL_CAMEL = "flatten(list_transform(regexp_extract_all(question, '[A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+'), lambda c: list_concat([lower(c)], list_filter(list_transform(regexp_extract_all(c, '[A-Z]?[a-z0-9]+'), lambda p: lower(p)), lambda p: length(p) >= 2))))"
SQL_TOKENS = f"""tokens AS (SELECT question_id, question, list_distinct_ordered AS tokens FROM (SELECT question_id, question, list_reduce(list_transform(list_concat(
 list_transform(regexp_extract_all(question, '[A-Za-z0-9_./-]+\\.[A-Za-z0-9_./-]+'), lambda x: lower(x)), list_transform(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_-]*(?:\\.[A-Za-z0-9_-]+)+'), lambda x: lower(x)),
 {SQL_CAMEL}, regexp_extract_all(lower(question), '[A-Za-z0-9=_-]{{2,}}'), {SQL_GRAMS}), lambda x: [x]), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS list_distinct_ordered FROM questions))"""
SQL_TOP_TOKENS = "picked AS (SELECT question_id, unnest(tokens) AS token FROM tokens)"


@query(f"WITH {sql_views('questions')}, {SQL_TOKENS} SELECT question_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INT AS n FROM tokens")
def tokenize_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = view(spark, sf, "questions").withColumn("t", T.tokens(F.col("question")))
    return q.select("question_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


SQL_INTENT = "CASE " + " ".join(f"WHEN {sql_any('lower(question)', w)} THEN '{k}'" for k, w in V.INTENTS.items()) + " ELSE 'GENERAL' END"


@query(f"WITH {sql_views('questions')} SELECT {SQL_INTENT} AS intent, count(*) AS n FROM questions GROUP BY 1")
def intent_counts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "questions").groupBy(T.intent(F.col("question")).alias("intent")).agg(F.count("*").alias("n"))


def _like(columns: dict[str, float], docs: str, key: str) -> str:
    score = " + ".join(f"CASE WHEN contains(lower({c}), token) THEN {w} ELSE 0 END" for c, w in columns.items())
    any_ = " OR ".join(f"contains(lower({c}), token)" for c in columns)
    return f"scored AS (SELECT question_id, {key} AS id, sum({score}) AS score FROM {docs}, picked WHERE {any_} GROUP BY ALL), ranked AS (SELECT question_id, id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INT AS rank FROM scored)"


# fixed values: weights of the channels' columns
REFKEY = {"keyword": 5.0, "concept_id": 4.0, "title": 2.0, "lang": 1.0}
CHUNK = {"content": 3.0, "title": 1.5, "concept_id": 1.0}
SOURCE = {"path": 4.0, "preview": 1.5, "content": 1.0}
SOURCE_CHUNK = {"path": 1.5, "content": 3.0}
CONTRIBUTION = {"question_text": 3.0, "answer_text": 4.0, "corrections": 1.5}


def _channel(spark: SparkSession, sf: str, docs: DataFrame, key: str, weights: dict[str, float], k: int = 8) -> DataFrame:
    return R.like_top(view(spark, sf, "questions"), docs, key, {"channel": weights}, k).select("question_id", "id", "score", "rank")


def _like_sql(docs_cte: str, docs: str, key: str, weights: dict[str, float], k: int = 8) -> str:
    return f"WITH {docs_cte}, {SQL_TOKENS}, {SQL_TOP_TOKENS}, {_like(weights, docs, key)} SELECT question_id, id, score::DOUBLE AS score, rank FROM ranked WHERE rank <= {k}"


@query(_like_sql(sql_views("questions", "articles"), "articles", "article_key", REFKEY))
def refkey_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _channel(spark, sf, view(spark, sf, "articles"), "article_key", REFKEY)


@query(_like_sql(sql_views("questions", "articles"), "articles", "article_key", CHUNK))
def chunk_like_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _channel(spark, sf, view(spark, sf, "articles"), "article_key", CHUNK)


@query(_like_sql(sql_views("questions", "files") + ", previews AS (SELECT *, substr(content, 1, 200) AS preview FROM files)", "previews", "id", SOURCE))
def source_like_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _channel(spark, sf, view(spark, sf, "files").withColumn("preview", T.excerpt(F.col("content"))), "id", SOURCE)


@query(_like_sql(sql_views("questions", "files"), "files", "id", SOURCE_CHUNK))
def source_chunk_like_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _channel(spark, sf, view(spark, sf, "files"), "id", SOURCE_CHUNK)


PAIRS_SQL = "turns AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role, CASE WHEN lead(role, 2) OVER w = 'user' THEN lead(text, 2) OVER w END AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pairs AS (SELECT conv_id || '-' || turn AS query_id, conv_id, turn, coalesce(text, '') AS question_text, coalesce(next_text, '') AS answer_text, coalesce(reply, '') AS corrections FROM turns WHERE role = 'user' AND next_role = 'assistant')"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's turn, the assistant's turn after it, and the user's reply to that as corrections."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("next_text", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.when(F.lead("role", 2).over(w) == "user", F.lead("text", 2).over(w)))
    return rows.where("role = 'user' AND next_role = 'assistant'").select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("question_text"), F.coalesce("next_text", F.lit("")).alias("answer_text"), F.coalesce("reply", F.lit("")).alias("corrections"))


@query(_like_sql(sql_views("questions") + ", " + PAIRS_SQL, "pairs", "query_id", CONTRIBUTION))
def contribution_like_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _channel(spark, sf, pairs(spark, sf), "query_id", CONTRIBUTION)


SQL_WORDS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: w <> '')"
def fts_sql(docs: str, key: str, column: str, p: str = "") -> str:
    """The CTE {p}fts: question_id, id, score. Covers end where every word of the question has stood; of those with one beginning the first end counts."""
    return f"""{p}terms AS (SELECT question_id, word, count(*) OVER (PARTITION BY question_id) AS n_terms FROM (SELECT DISTINCT question_id, unnest({SQL_WORDS.format(c='question')}) AS word FROM questions)),
 {p}held AS (SELECT id, word, pos FROM (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT {key} AS id, {SQL_WORDS.format(c=f"coalesce({column}, '')")} AS w FROM {docs})) WHERE word IN (SELECT word FROM {p}terms)),
 {p}met AS (SELECT question_id, id FROM {p}held JOIN {p}terms USING (word) GROUP BY question_id, id, n_terms HAVING count(DISTINCT word) = n_terms),
 {p}entries AS (SELECT m.question_id, m.id, t.word, pos, row_number() OVER (PARTITION BY m.question_id, m.id ORDER BY pos) AS i FROM {p}met m JOIN {p}terms t ON t.question_id = m.question_id JOIN {p}held h ON h.id = m.id AND h.word = t.word),
 {p}lasts AS (SELECT e.question_id, e.id, e.i, e.pos, max(CASE WHEN e.word = t.word THEN e.i END) OVER (PARTITION BY e.question_id, e.id, t.word ORDER BY e.i) AS last FROM {p}entries e JOIN {p}terms t ON t.question_id = e.question_id),
 {p}ends AS (SELECT question_id, id, i, pos, min(last) AS b FROM {p}lasts GROUP BY question_id, id, i, pos HAVING count(last) = count(*)),
 {p}covers AS (SELECT question_id, id, b, min(i) AS i, min(pos) AS q FROM {p}ends GROUP BY question_id, id, b),
 {p}fts AS (SELECT c.question_id, c.id, sum(0.1 / (1 + (c.q - e.pos) - (c.i - c.b))) AS score FROM {p}covers c JOIN {p}entries e ON e.question_id = c.question_id AND e.id = c.id AND e.i = c.b GROUP BY c.question_id, c.id)"""


FTS_SQL = fts_sql("documents", "doc_id", "text")


@query(f"WITH {sql_views('questions')}, {FTS_SQL} SELECT question_id, id, round(score, 6)::DOUBLE AS score FROM fts")
def fts_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.fts_match(view(spark, sf, "questions"), table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("question_id", "id", F.round("score", 6).alias("score"))


def _lexical_sql(views: str, docs: str, key: str, weights: dict[str, float], fts: dict[str, float], k: int = 8) -> str:
    """Token weights and full-text ranks of all rows that hold any token or, in a column, all words of a question."""
    parts = [fts_sql(docs, key, c, f"f{i}_") for i, c in enumerate(fts)]
    ranks = " UNION ALL ".join(f"SELECT question_id, id, score * {w} AS score FROM f{i}_fts" for i, w in enumerate(fts.values()))
    return f"""WITH {views}, {SQL_TOKENS}, {SQL_TOP_TOKENS}, {_like(weights, docs, key)}, {', '.join(parts)},
 total AS (SELECT question_id, id, round(sum(score), 9) AS score FROM (SELECT question_id, id, score FROM scored UNION ALL {ranks}) GROUP BY question_id, id),
 best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INT AS rank FROM total) SELECT question_id, id, score::DOUBLE AS score, rank FROM best WHERE rank <= {k}"""


def _lexical(spark: SparkSession, sf: str, docs: DataFrame, key: str, weights: dict[str, float], fts: dict[str, float], k: int = 8) -> DataFrame:
    found = R.lexical(view(spark, sf, "questions"), docs, key, weights, 2 * k, fts).withColumn("score", F.round("score", 9))
    return R.top_k(found, k, "id")


@query(_lexical_sql(sql_views("questions") + ", " + PAIRS_SQL, "pairs", "query_id", CONTRIBUTION, CONTRIBUTION))
def contribution_search(spark: SparkSession, sf: str) -> DataFrame:
    """Question-answer pairs with corrections: full-text ranks of three columns and token weights."""
    return _lexical(spark, sf, pairs(spark, sf), "query_id", CONTRIBUTION, CONTRIBUTION)


@query(_lexical_sql(sql_views("questions", "files") + ", previews AS (SELECT *, substr(content, 1, 200) AS preview FROM files)", "previews", "id", SOURCE, {"content": 1.0}))
def source_search(spark: SparkSession, sf: str) -> DataFrame:
    """Source files: the full-text rank of the content and token weights."""
    return _lexical(spark, sf, view(spark, sf, "files").withColumn("preview", T.excerpt(F.col("content"))), "id", SOURCE, {"content": 1.0})


@query(_lexical_sql(sql_views("questions", "articles"), "articles", "article_key", CHUNK, {"content": 1.0}))
def article_search(spark: SparkSession, sf: str) -> DataFrame:
    """Articles: the full-text rank of the content and token weights."""
    return _lexical(spark, sf, view(spark, sf, "articles"), "article_key", CHUNK, {"content": 1.0})


SQL_SIGNAL = "len(list_filter(tokens, lambda t: NOT (length(t) <= 1) AND (regexp_matches(t, '^[\\x00-\\x7F]+$') AND length(t) >= 4 OR regexp_matches(t, '[_\\-=/.]') OR regexp_matches(t, '\\p{Han}')))) > 0"
SQL_BASE = " UNION ALL ".join(f"SELECT '{c}' AS channel, {w}::DOUBLE AS base" for c, w in V.CHANNELS.items())
SQL_BOOST = "CASE " + " ".join(f"WHEN intent = '{i}' AND channel = '{c}' THEN {w}::DOUBLE" for i, m in V.INTENT_BOOST.items() for c, w in m.items()) + " ELSE 1.0::DOUBLE END"
SQL_SEMANTIC = "CASE WHEN intent IN ('GENERAL', 'ARCHITECTURE') AND signal THEN CASE channel " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in V.SEMANTIC_BOOST.items()) + " ELSE 1.0::DOUBLE END ELSE 1.0::DOUBLE END"
SQL_WEIGHTS = f"""signals AS (SELECT question_id, {SQL_INTENT} AS intent, {SQL_SIGNAL} AS signal FROM tokens),
 weights AS (SELECT question_id, intent, channel, CASE WHEN channel IN ('article_vector', 'chunk_vector') AND (intent IN ('CODE_STRUCTURE', 'CONFIGURATION') OR NOT signal) THEN 0.0 ELSE base * {SQL_BOOST} * {SQL_SEMANTIC} END AS weight FROM signals, ({SQL_BASE}))"""


@query(f"WITH {sql_views('questions')}, {SQL_TOKENS}, {SQL_WEIGHTS} SELECT question_id, intent, channel, round(weight, 9)::DOUBLE AS weight FROM weights")
def channel_weights(spark: SparkSession, sf: str) -> DataFrame:
    return R.channel_weights(view(spark, sf, "questions")).withColumn("weight", F.round("weight", 9))


def hits(spark: SparkSession, sf: str, k: int = 8) -> DataFrame:
    """The reference-key and the chunk channel, in one pass over the articles."""
    found = R.like_top(view(spark, sf, "questions"), view(spark, sf, "articles"), "article_key", {"refkey": REFKEY, "article_chunk_fts": CHUNK}, k)
    return found.select("question_id", "channel", F.lit("ARTICLE").alias("evidence_type"), F.col("id").alias("key"), "score", "rank")


def _hits_sql() -> str:
    a, b = _like(REFKEY, "articles", "article_key"), _like(CHUNK, "articles", "article_key").replace("scored", "scored2").replace("ranked", "ranked2")
    return f"{sql_views('questions', 'articles')}, {SQL_TOKENS}, {SQL_TOP_TOKENS}, {a}, {b}, hits AS (SELECT question_id, 'refkey' AS channel, id AS key, score, rank FROM ranked WHERE rank <= 8 UNION ALL SELECT question_id, 'article_chunk_fts', id, score, rank FROM ranked2 WHERE rank <= 8), {SQL_WEIGHTS}, fused AS (SELECT question_id, key, round(sum(weight / (60 + rank)), 12) AS score FROM hits JOIN weights USING (question_id, channel) GROUP BY ALL), top AS (SELECT question_id, key, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key)::INT AS rank FROM fused)"


@query(f"WITH {_hits_sql()} SELECT question_id, key, round(score, 9)::DOUBLE AS score, rank, title FROM top JOIN articles ON key = article_key WHERE rank <= 5")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: tokens, two channels, intent-dependent weights, weighted rank fusion, top 5 with titles."""
    questions = view(spark, sf, "questions")
    fused = R.fuse(hits(spark, sf), R.channel_weights(questions))
    titles = view(spark, sf, "articles").select(F.col("article_key").alias("key"), "title")
    return fused.join(titles, "key").select("question_id", "key", F.round("score", 9).alias("score"), "rank", "title")


@query(f"WITH {_hits_sql()} SELECT question_id, key, round(score, 9)::DOUBLE AS score, rank FROM top WHERE rank <= 8")
def answer_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The 8 fused hits that an answer is made from."""
    return R.fuse(hits(spark, sf), R.channel_weights(view(spark, sf, "questions")), limit=8).select("question_id", "key", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_hits_sql()} SELECT question_id, channel, h.key, h.rank, t.rank AS fused_rank FROM hits h LEFT JOIN (SELECT * FROM top WHERE rank <= 5) t USING (question_id, key)")
def rrf_audit(spark: SparkSession, sf: str) -> DataFrame:
    h = hits(spark, sf)
    return R.audit(h, R.fuse(h, R.channel_weights(view(spark, sf, "questions")))).select("question_id", "channel", "key", "rank", "fused_rank")


CANDIDATES_SQL = "list_filter(tokens, lambda t: regexp_matches(t, '^[a-z0-9_-]{2,}$'))"


def _hit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and the articles that a channel finds for them, each pair once."""
    pairs_ = hits(spark, sf).select("question_id", F.col("key").alias("article_key")).distinct()
    return pairs_.join(view(spark, sf, "questions"), "question_id").join(view(spark, sf, "articles"), "article_key")


HIT_PAIRS_SQL = f"{_hits_sql()}, met AS (SELECT question_id, question, tokens, a.* FROM (SELECT DISTINCT question_id, key FROM hits) JOIN tokens USING (question_id) JOIN articles a ON key = article_key)"
WINDOWS_SQL = " OR ".join(f"contains({c}, array_to_string({CANDIDATES_SQL}[i : i + n], '{sep}'))" for c in ("p", "whole") for sep in "._-")
BONUS_SQL = f"""rows AS (SELECT question_id, question, tokens, doc_id, {SQL_INTENT} AS intent, CASE doc_id % 4 WHEN 0 THEN 'conf/app.yaml' WHEN 1 THEN 'adr/readme.md' WHEN 2 THEN 'img/a.png' ELSE 'docs/payment.retry.txt' END AS p, lower(article_key || ' ' || concept_id || ' ' || title) AS names, lower(article_key || ' ' || concept_id || ' ' || title || ' ' || content) AS whole FROM met),
 flags AS (SELECT *, list_bool_or(list_transform(range(1, len({CANDIDATES_SQL}) + 1), lambda i: list_bool_or(list_transform([1, 2, 3], lambda n: i + n <= len({CANDIDATES_SQL}) AND ({WINDOWS_SQL}))))) AS fact FROM rows)"""


@query(f"""WITH {HIT_PAIRS_SQL}, {BONUS_SQL}
SELECT question_id, doc_id, (CASE WHEN intent = 'CONFIGURATION' THEN CASE WHEN fact THEN 18 ELSE 0 END + CASE WHEN p LIKE '%.yaml' THEN 6 ELSE 0 END - CASE WHEN p LIKE '%.png' THEN 18 ELSE 0 END - CASE WHEN {sql_any("(names || ' ' || p)", V.META_PARTS)} THEN 10 ELSE 0 END
 WHEN intent = 'ARCHITECTURE' OR {sql_any('lower(question)', V.INTENTS['ARCHITECTURE'])} THEN CASE WHEN {sql_any('p', V.ARCHITECTURE_PARTS)} THEN 12 ELSE 0 END - CASE WHEN p LIKE '%.png' THEN 14 ELSE 0 END - CASE WHEN {sql_any("(names || ' ' || p)", V.META_PARTS)} THEN 8 ELSE 0 END ELSE 0 END)::DOUBLE AS bonus FROM flags""")
def rerank_bonus(spark: SparkSession, sf: str) -> DataFrame:
    """What the intent adds to every hit of the two channels."""
    rows = _hit_pairs(spark, sf).withColumn("p", F.expr("CASE doc_id % 4 WHEN 0 THEN 'conf/app.yaml' WHEN 1 THEN 'adr/readme.md' WHEN 2 THEN 'img/a.png' ELSE 'docs/payment.retry.txt' END"))
    bonus = R.intent_bonus(F.col("question"), T.intent(F.col("question")), F.col("article_key"), F.col("concept_id"), F.col("title"), F.col("content"), F.array("p"))
    return rows.select("question_id", "doc_id", bonus.alias("bonus"))


SQL_SPECIAL, SQL_ASCII, SQL_HAN = "regexp_matches(t, '[_\\-=/.]')", "regexp_matches(t, '^[\\x00-\\x7F]+$')", "regexp_matches(t, '\\p{Han}')"
SQL_GENERIC = f"(t IN ({', '.join(map(quoted, V.GENERIC_TOKENS))}) OR length(t) <= 1 OR starts_with(t, '请') OR suffix(t, '什么') OR regexp_matches(t, '^[{V.GENERIC_CHARS}]+$'))"
SQL_WEIGHT = f"(CASE WHEN {SQL_SPECIAL} THEN 6 WHEN {SQL_ASCII} THEN CASE WHEN length(t) >= 6 THEN 5 ELSE 4 END WHEN {SQL_HAN} AND length(t) >= 4 THEN 5 WHEN {SQL_HAN} AND length(t) = 3 THEN 4 ELSE 3 END)"
FOCUS_SQL = f"""f1 AS (SELECT question_id, trim(question) AS q FROM questions), f2 AS (SELECT question_id, CASE WHEN instr(q, '对比') > 0 AND instr(q, '对比') - 1 < length(q) - 2 THEN trim(substr(q, instr(q, '对比') + 2)) ELSE q END AS q FROM f1),
 focused AS (SELECT question_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(replace(q, '有什么区别', ''), '区别是什么', ''), '的关键结论是什么', ''), '[？?。！!]+$', ''), '是什么$', '')), '吗$', '')) AS question FROM f2),
 {SQL_TOKENS.replace("tokens AS (SELECT question_id, question, list_distinct_ordered", "ftokens AS (SELECT question_id, question, list_distinct_ordered").replace("FROM questions))", "FROM focused))")},
 kept AS (SELECT question_id, list_filter(tokens, lambda t: NOT {SQL_GENERIC} AND (({SQL_ASCII} AND length(t) >= 4) OR {SQL_SPECIAL} OR ({SQL_HAN} AND length(t) >= 2))) AS k FROM ftokens),
 signal AS (SELECT question_id, CASE WHEN len(k) > 0 THEN k ELSE list_filter(tokens, lambda t: NOT {SQL_GENERIC})[1:3] END AS s FROM kept JOIN tokens USING (question_id))"""
STRUCTURED_SQL = "(contains(k, t) OR contains(ti, t) OR contains(d, t) OR contains(p, t))"


@query(f"""WITH {HIT_PAIRS_SQL}, {FOCUS_SQL},
 rows AS (SELECT question_id, doc_id, s, lower(article_key) AS k, lower(title) AS ti, lower(summary) AS d, lower(path) AS p, lower(content) AS c FROM met JOIN signal USING (question_id)),
 judged AS (SELECT question_id, doc_id, coalesce(list_sum(list_transform(s, lambda t: CASE WHEN {STRUCTURED_SQL} THEN {SQL_WEIGHT} + 6 WHEN contains(c, t) THEN {SQL_WEIGHT} + 2 ELSE 0 END)), 0)::INT AS score,
  list_filter(s, lambda t: {SQL_SPECIAL} OR {SQL_ASCII}) AS entities, len(list_filter(s, lambda t: ({SQL_SPECIAL} OR {SQL_ASCII}) AND {STRUCTURED_SQL})) > 0 AS named, len(list_filter(s, lambda t: ({SQL_SPECIAL} OR {SQL_ASCII} OR ({SQL_HAN} AND length(t) >= 3)) AND ({STRUCTURED_SQL} OR contains(c, t)))) AS strong FROM rows)
SELECT question_id, doc_id, score AS relevance_score, score > 0 AND CASE WHEN len(entities) > 0 THEN named OR score >= 8 ELSE strong >= 1 OR score >= 5 END AS relevant FROM judged""")
def relevance_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Scores and acceptance of every hit of the two channels, for all questions."""
    rows = _hit_pairs(spark, sf).select("question_id", "question", "doc_id", F.col("article_key").alias("key"), F.lit("").alias("concept_id"), "title", F.col("summary").alias("description"), "content", F.array("path").alias("paths"))
    return R.relevance(rows).select("question_id", "doc_id", "relevance_score", "relevant")


RULES = [("config", "参数 retry"), ("retry", "重试"), ("class", "源码")]


@query(f"""WITH {sql_views('questions')}, a AS (SELECT question_id, question || CASE WHEN contains(lower(question), 'config') AND NOT contains(question, '参数 retry') THEN ' 参数 retry' ELSE '' END AS q FROM questions),
 b AS (SELECT question_id, q || CASE WHEN contains(lower(q), 'retry') AND NOT contains(q, '重试') THEN ' 重试' ELSE '' END AS q FROM a)
SELECT question_id, q || CASE WHEN contains(lower(q), 'class') AND NOT contains(q, '源码') THEN ' 源码' ELSE '' END AS rewritten FROM b""")
def rewrite_apply(spark: SparkSession, sf: str) -> DataFrame:
    return R.rewrite(view(spark, sf, "questions"), RULES).select("question_id", "rewritten")


@query(f"""WITH {sql_views('questions')}, {SQL_TOKENS}, {SQL_WEIGHTS}, r AS (SELECT question_id, contains(lower(question), 'config') AND NOT contains(question, '参数 retry') OR contains(lower(question), 'retry') AND NOT contains(question, '重试') OR contains(lower(question), 'class') AND NOT contains(question, '源码') AS rewrite FROM questions)
SELECT question_id, 'intent=' || intent || '|mode=parallel|rewrite=' || CASE WHEN rewrite THEN 'on' ELSE 'off' END || '|graph=' || CASE WHEN bool_or(channel = 'graph' AND weight > 0) THEN 'on' ELSE 'off' END || '|vector=' || CASE WHEN bool_or(channel IN ('article_vector', 'chunk_vector') AND weight > 0) THEN 'on' ELSE 'off' END AS tag
FROM weights JOIN r USING (question_id) GROUP BY question_id, intent, rewrite""")
def strategy_tags(spark: SparkSession, sf: str) -> DataFrame:
    questions = view(spark, sf, "questions")
    return R.strategy_tags(R.channel_weights(questions), R.rewrite(questions, RULES))


VECTOR_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT a.vec_id AS question_id, b.vec_id AS id, b.label, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 9) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INT AS rank FROM p) """


def _knn(spark: SparkSession, sf: str, k: int = 8) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return R.cosine_top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "embedding"), v.select(F.col("vec_id").alias("id"), "embedding"), k)


@query(VECTOR_SQL + "SELECT question_id, id, score::DOUBLE AS score, rank FROM r WHERE rank <= 8")
def vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf)


@query(VECTOR_SQL + ", c AS (SELECT question_id, id, score, rank, id // 10 AS key FROM r WHERE rank <= 8), b AS (SELECT *, row_number() OVER (PARTITION BY question_id, key ORDER BY score DESC, rank) AS n FROM c) SELECT question_id, key, id, score::DOUBLE AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key)::INT AS rank FROM b WHERE n = 1")
def chunk_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return R.best_chunk(_knn(spark, sf).withColumn("key", F.floor(F.col("id") / 10))).select("question_id", "key", "id", "score", "rank")


@query("""SELECT 'doc-' || doc_id AS key, sha256(coalesce(text, '')) AS content_hash, CASE WHEN doc_id % 3 = 0 THEN 'SKIP' ELSE 'INDEX' END AS action FROM documents""")
def vector_worklist(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "articles").select(F.col("article_key").alias("key"), "content", "doc_id")
    had = a.where("doc_id % 3 != 1").select("key", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.col("content")).otherwise("old"), 256).alias("content_hash"), F.lit("p1").alias("profile"), F.lit(64).alias("dims"))
    return R.vector_worklist(a.select("key", "content"), had, "p1", 64)


DEEP_SQL = "(" + " + ".join(f"(length({{t}}) - length(replace({{t}}, {quoted(d)}, ''))) // {len(d)}" for d in V.DELIMITERS) + ")"
FIRST_SQL = "list_min(list_filter([" + ", ".join(f"instr(lower(q), {quoted(c)})" for c in V.COMPARISONS) + "], lambda i: i > 0))"


@query(f"""WITH {sql_views('questions')}, t AS (SELECT question_id, question || CASE question_id % 4 WHEN 0 THEN ' a、b、c 区别' WHEN 1 THEN ' 为什么' WHEN 2 THEN ' x vs y, z' ELSE '' END AS q FROM questions), f AS (SELECT *, {FIRST_SQL} AS first FROM t)
SELECT question_id, ({sql_any('lower(q)', V.COMPARISONS)} AND (coalesce(first > 1 AND {DEEP_SQL.format(t='substr(lower(q), 1, (first - 1)::INT)')} >= 2, false) OR (length(q) >= 32 AND {DEEP_SQL.format(t='lower(q)')} >= 3))) OR {sql_any('lower(q)', V.DEEP_WORDS)} AS deep,
 CASE WHEN {sql_any('q', ['区别', '对比'])} THEN 'COMPARE' WHEN {sql_any('q', ['为什么', '原因'])} THEN 'CAUSE' WHEN {sql_any('q', ['如何', '策略', '方案'])} THEN 'POLICY' ELSE 'FACT_LOOKUP' END AS task FROM f""")
def deep_research_route(spark: SparkSession, sf: str) -> DataFrame:
    q = view(spark, sf, "questions").selectExpr("question_id", "question || CASE question_id % 4 WHEN 0 THEN ' a、b、c 区别' WHEN 1 THEN ' 为什么' WHEN 2 THEN ' x vs y, z' ELSE '' END AS q")
    return q.select("question_id", T.is_deep(F.col("q")).alias("deep"), T.task_type(F.col("q")).alias("task"))


def _channels(spark: SparkSession, sf: str, k: int) -> dict:
    """The nine channels over articles, files, question-answer pairs, parts as entities, and embeddings; each from questions to hits."""
    articles, files, answered = view(spark, sf, "articles"), view(spark, sf, "files").withColumn("preview", T.excerpt(F.col("content"))), cut(pairs(spark, sf))
    vectors = table(spark, sf, "embeddings")
    none = F.array().cast("array<string>")
    article = articles.select(F.col("article_key").alias("key"), "concept_id", "title", F.col("summary").alias("description"), "content", F.filter(F.array("path", "path2"), lambda p: p != "").alias("paths"), "doc_id")
    file = files.select("id", F.col("path").alias("key"), F.lit("").alias("concept_id"), F.col("path").alias("title"), F.lit("").alias("description"), "content", F.array("path").alias("paths"))
    fields = ["question_id", "evidence_type", "key", "concept_id", "title", "description", "content", "paths", "score"]

    def hits_of(found: DataFrame, details: DataFrame, on: str, kind: str) -> DataFrame:
        # some hits for each question: written, so that the planner knows it and doesn't shuffle the details' texts to meet them
        return cut(found).join(details, on).withColumn("evidence_type", F.lit(kind)).select(*fields)

    def chunks_of(rows: DataFrame, key: str, *more: str) -> DataFrame:
        rows = C.chunked(rows, key, "content", keep=more).withColumnRenamed(key, "owner")
        return rows.withColumn("id", F.concat_ws("#", F.col("owner").cast("string"), F.col("chunk_index").cast("string")))

    # each is read by several channels and steps
    article_chunks = cut(chunks_of(articles, "article_key", "title", "concept_id"))
    file_chunks = cut(chunks_of(files, "id", "path"))
    entities = spark.sql("SELECT p_partkey AS entity_id, p_name AS canonical_name, split_part(p_name, ' ', 2) AS simple_name, p_size % 5 = 0 AS unresolved FROM {p}", p=table(spark, sf, "part"))
    lines = spark.sql("SELECT l_partkey AS entity_id, l_orderkey * 10 + l_linenumber AS id, 'flag' AS predicate, l_returnflag AS value, 'supplies' AS edge_type, CAST(l_suppkey AS STRING) AS dst, l_discount AS confidence, false AS tombstoned, CAST(NULL AS STRING) AS superseded_by FROM {l}", l=table(spark, sf, "lineitem"))

    def blocks(only: DataFrame) -> DataFrame:
        """Of some entities (entity_id), so that the lines of others aren't sorted."""
        mine = lines.join(only, "entity_id", "left_semi")
        return graph.facts_block(entities.join(only, "entity_id", "left_semi"), mine, mine)

    def entity_hits(asked: DataFrame) -> DataFrame:
        found = cut(graph.entity_search(asked, entities, blocks, k).drop("rank"))
        rows = entities.join(blocks(cut(found.select("entity_id").distinct())), "entity_id")
        name = F.col("canonical_name")
        return hits_of(found, rows.select("entity_id", name.alias("key"), F.lit("").alias("concept_id"), name.alias("title"), F.lit("").alias("description"), F.col("block").alias("content"), none.alias("paths")), "entity_id", "GRAPH")

    def nearest(asked: DataFrame) -> DataFrame:
        own = vectors.select(F.col("vec_id").alias("question_id"), "embedding").join(asked.select("question_id"), "question_id", "left_semi")
        return R.cosine_top_k(own, vectors.select(F.col("vec_id").alias("id"), "embedding"), k).drop("rank")

    with_doc = lambda df, doc: hits_of(df.select("question_id", "score", doc.alias("doc_id")), article, "doc_id", "ARTICLE")
    chunk_hits = lambda df, chunks, details, on, kind: hits_of(cut(df).join(chunks.select("id", F.col("owner").alias(on)), "id").drop("id"), details, on, kind)
    contribution = answered.select(F.col("query_id").alias("key"), F.lit("").alias("concept_id"), F.col("question_text").alias("title"), F.lit("").alias("description"), F.col("answer_text").alias("content"), none.alias("paths"))
    rank = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    few = lambda df: df.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= k).drop("_n")
    return {
        "fts": lambda q: hits_of(few(R.fts_match(q, articles, "article_key", "content")).withColumnRenamed("id", "key"), article, "key", "ARTICLE"),
        "article_chunk_fts": lambda q: chunk_hits(R.lexical(q, article_chunks, "id", {"chunk": 3.0, "title": 1.5, "concept_id": 1.0}, k, "chunk"), article_chunks, article, "key", "ARTICLE"),
        "refkey": lambda q: hits_of(R.lexical(q, articles, "article_key", REFKEY, k).withColumnRenamed("id", "key"), article, "key", "ARTICLE"),
        "source": lambda q: hits_of(R.lexical(q, files, "id", SOURCE, k, "content"), file, "id", "SOURCE"),
        "source_chunk_fts": lambda q: chunk_hits(R.lexical(q, file_chunks, "id", {"path": 1.5, "chunk": 3.0}, k, "chunk"), file_chunks.withColumn("owner", F.col("path")), file, "key", "SOURCE"),
        "contribution": lambda q: hits_of(R.lexical(q, answered, "query_id", CONTRIBUTION, k, CONTRIBUTION).withColumnRenamed("id", "key"), contribution, "key", "CONTRIBUTION"),
        "graph": entity_hits,
        "article_vector": lambda q: with_doc(nearest(q), F.col("id")),
        "chunk_vector": lambda q: with_doc(nearest(q), F.floor(F.col("id") / 10)),
    }


def searched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The nine-channel search of all questions, and its audit."""
    return R.search(view(spark, sf, "questions"), _channels(spark, sf, 5), RULES, 5)


@query()
def knowledge_search(spark: SparkSession, sf: str) -> DataFrame:
    """All nine channels: rewrite, strategy, search, rerank, fusion, relevance; checked in the tests."""
    return searched(spark, sf)[0].select("question_id", "evidence_type", "key", F.round("score", 9).alias("score"), "rank", "relevant")


@query()
def research_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Of the lexical hits those that a research task keeps; checked in the tests."""
    rows = _hit_pairs(spark, sf).select("question_id", "question", F.when(F.col("doc_id") % 10 == 0, "GRAPH").otherwise("ARTICLE").alias("evidence_type"), F.col("article_key").alias("key"), "concept_id", "title", F.col("summary").alias("description"), "content", F.array("path").alias("paths"))
    return R.research_hits(R.relevance(rows)).select("question_id", "key", "evidence_type", "relevant")


ASKING = "question || CASE question_id % 5 WHEN 0 THEN ' the 和 and、retry 分别是多少' WHEN 1 THEN ' 有哪些' WHEN 2 THEN ' 流程' WHEN 3 THEN ' 当前状态' ELSE '' END"


def asked_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the two channels for questions of all types."""
    rows = _hit_pairs(spark, sf).withColumn("question", F.expr(ASKING)).withColumn("tokens", T.tokens(F.col("question")))
    return rows.select("question_id", "question", "tokens", "content", F.col("doc_id").alias("rank"))


@query()
def focused_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The lines that answer each question best, its parts covered first; checked against a plain greedy in the tests."""
    return A.focused_answer(asked_hits(spark, sf))


@query()
def question_split(spark: SparkSession, sf: str) -> DataFrame:
    """Partial questions of comparisons and causes; checked in the tests."""
    q = view(spark, sf, "questions").select("question_id", F.concat("question", F.lit(" 甲和乙有什么区别？")).alias("q"))
    return q.select("question_id", F.posexplode(T.split_question(F.col("q"))).alias("place", "part"))


@query(f"WITH {sql_views('articles', 'files')} SELECT DISTINCT a.source_id AS article_source, f.source_id AS file_source, f.lang FROM articles a JOIN files f ON a.path = f.path")
def article_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that articles and files of one path come from, each pair once."""
    a = view(spark, sf, "articles").select(F.col("source_id").alias("article_source"), "path")
    f = view(spark, sf, "files").select(F.col("source_id").alias("file_source"), "path", "lang")
    return a.join(f, "path").select("article_source", "file_source", "lang").distinct()


@query(f"WITH {sql_views('articles')} SELECT row_number() OVER (ORDER BY lifecycle NULLS FIRST, source_id, article_key) AS place, article_key FROM articles")
def article_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All articles in a fixed order with their places: sorted by range, numbered by the sizes of the ranges before."""
    return R.numbered(view(spark, sf, "articles").select("article_key", "source_id", "lifecycle"), [F.asc_nulls_first("lifecycle"), "source_id", "article_key"]).select("place", "article_key")
