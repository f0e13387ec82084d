"""Queries that build a persistent index or table and read it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fulltext, planning, segment, snapshots, tables, vectors
from ..operators.adapt import sql_views, table, view
from ..operators.common import shared_dir
from ..streaming import expiry
from .catalogue import query
from .retrieval import FTS_SQL, VECTOR_SQL

#: Benchmark texts and the short first turns of conversations.
ASKED = """SELECT item_id AS question_id, coalesce(text, '') AS question FROM {benchmark}
 UNION ALL SELECT 1000000 + conv_id, text FROM {conversations} WHERE turn = 0 AND length(text) BETWEEN 1 AND 60"""


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(ASKED, benchmark=table(spark, sf, "benchmark"), conversations=table(spark, sf, "conversations"))


FTS_RANK_SQL = f"""WITH questions AS ({ASKED.format(benchmark='benchmark', conversations='conversations')}), {FTS_SQL}, ranked AS (SELECT question_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM fts)
SELECT question_id, id, score::DOUBLE AS score, rank FROM ranked WHERE rank <= 8"""


@query(FTS_RANK_SQL)
def fts_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The 8 best documents of each question by cover density, from an index of all documents: a third of them is indexed first with texts that are then replaced, the rest is added."""
    docs, folder = table(spark, sf, "documents").select("doc_id", "text"), _fresh(spark, "fulltext")
    fulltext.add(docs.where("doc_id % 3 = 0").withColumn("text", F.reverse("text")), "doc_id", "text", folder)
    fulltext.add(docs, "doc_id", "text", folder)
    return _best(fulltext.search(spark, _asked(spark, sf), folder, 8, 9), 8)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Ranked by rounded scores, so that sums in another order don't change a tie."""
    rows = found.withColumn("score", F.round("score", 9))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("question_id", "id", "score", "rank")


def _vector_index(spark: SparkSession, sf: str) -> str:
    """An index built on nine tenths of the vectors (some of them with values that are then replaced); the rest is added."""
    v, folder = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), _fresh(spark, "vectors")
    old = F.when(F.col("id") % 10 == 1, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    vectors.build(v.where("id % 10 != 0").withColumn("embedding", old), folder)
    vectors.add(v.where("id % 10 < 2"), folder)
    return folder


@query(VECTOR_SQL + "SELECT question_id, id, score::DOUBLE AS score, rank FROM r WHERE rank <= 8")
def vector_lists_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The 8 nearest vectors of every hundredth one, all lists of a persistent index probed."""
    asked = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return vectors.search(spark, asked, _vector_index(spark, sf), 8)


@query()
def vector_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The same with half of the lists probed; recall is measured in the tests."""
    asked = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return vectors.search(spark, asked, _vector_index(spark, sf), 8, probes=50)


LINES = "SELECT doc_id, pos AS place, line FROM (SELECT doc_id, posexplode(split({text}, '\\n')) AS (pos, line) FROM {d})"
SQL_LINES = "SELECT doc_id, unnest(range(0, len(l)))::INT AS place, unnest(l) AS line FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM documents)"


def _chunk_table(spark: SparkSession, sf: str) -> str:
    """Lines of documents as chunks of their owners: all rebuilt, then some replaced and some deleted by one batch, which is played twice."""
    docs, folder = table(spark, sf, "documents"), _fresh(spark, "chunks")
    lines = lambda text: spark.sql(LINES.replace("{text}", text), d=docs)
    tables.rebuild(lines("coalesce(text, '')"), folder, 0)
    for _ in range(2):
        tables.replace(lines("replace(coalesce(text, ''), 'e', '3')").where("doc_id % 5 = 0"), folder, 1, docs.where("doc_id % 7 = 0").select("doc_id"))
    return folder


@query(f"""WITH a AS ({SQL_LINES.format(text="coalesce(text, '')")}), b AS ({SQL_LINES.format(text="replace(coalesce(text, ''), 'e', '3')")})
SELECT doc_id, place, sha256(line) AS chunk_hash FROM (SELECT * FROM a WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT * FROM b WHERE doc_id % 5 = 0)""")
def chunk_table(spark: SparkSession, sf: str) -> DataFrame:
    """What a table of chunks holds after a rebuild and a batch that replaces and deletes."""
    return tables.read(spark, _chunk_table(spark, sf)).select("doc_id", "place", F.sha2("line", 256).alias("chunk_hash"))


@query(f"""WITH a AS (SELECT doc_id, count(*) AS n FROM ({SQL_LINES.format(text="coalesce(text, '')")}) GROUP BY 1), t AS (SELECT doc_id, NOT contains(coalesce(text, ''), 'e') AS same FROM documents)
SELECT doc_id, 0::BIGINT AS batch, 'rebuild' AS reason, 'ADDED' AS change, 0::BIGINT AS rows_old, n AS rows_new FROM a
UNION ALL SELECT doc_id, 1, 'replace', CASE WHEN doc_id % 5 <> 0 THEN 'REMOVED' WHEN same THEN 'SAME' ELSE 'CHANGED' END, n, CASE WHEN doc_id % 5 = 0 THEN n ELSE 0 END FROM a JOIN t USING (doc_id) WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def chunk_history(spark: SparkSession, sf: str) -> DataFrame:
    """The history that the same batches leave."""
    return tables.history(spark, _chunk_table(spark, sf)).drop("hash_old", "hash_new")


@query(f"SELECT doc_id, place, sha256(line) AS chunk_hash FROM ({SQL_LINES.format(text="coalesce(text, '')")})")
def streamed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of files into a table of chunks, one commit for each micro-batch."""
    folder, path = _fresh(spark, "streamed"), f"{sf}/documents.parquet"
    # as a pattern the path may be a file or a folder
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")
    lines = source.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    tables.stream(lines, folder, _fresh(spark, "progress")).awaitTermination()
    return tables.read(spark, folder).select("doc_id", "place", F.sha2("line", 256).alias("chunk_hash"))


ITEMS = "SELECT 'doc' AS type, CAST(doc_id AS STRING) AS id, sha2(payload, 256) AS hash, payload FROM (SELECT doc_id, {payload} AS payload FROM {d})"
CHANGED = "CASE WHEN doc_id % 50 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END"


def _snapshots(spark: SparkSession, sf: str) -> str:
    """Two snapshots of all documents, the first named as the baseline; then back to it."""
    docs, folder = table(spark, sf, "documents").select("doc_id", "text"), _fresh(spark, "snapshots")
    snapshots.name(spark, folder, snapshots.take(spark.sql(ITEMS.replace("{payload}", "coalesce(text, '')"), d=docs.where("doc_id % 50 != 2")), folder), "baseline")
    snapshots.take(spark.sql(ITEMS.replace("{payload}", CHANGED), d=docs.where("doc_id % 50 != 1")), folder)
    snapshots.roll_back(spark, folder, snapshots.named(spark, folder, "baseline"))
    return folder


@query("SELECT 'doc' AS type, doc_id::VARCHAR AS id, CASE doc_id % 50 WHEN 0 THEN 'MODIFIED' WHEN 1 THEN 'REMOVED' ELSE 'ADDED' END AS change FROM documents WHERE doc_id % 50 < 3")
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What changed from the baseline to the second snapshot, from the leaves in which their trees differ."""
    return snapshots.diff(spark, _snapshots(spark, sf), 0, 1).select("type", "id", "change")


@query("SELECT 'doc' AS type, doc_id::VARCHAR AS id, sha256(coalesce(text, '')) AS hash, length(coalesce(text, ''))::INT AS n FROM documents WHERE doc_id % 50 <> 2")
def snapshot_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The repository after it was rolled back to the baseline, payloads included."""
    return snapshots.read(spark, _snapshots(spark, sf), 2).select("type", "id", "hash", F.length("payload").alias("n"))


#: Users' clicks and views put an entry, purchases evict it, all else reads it; an entry lives for six hours.
KINDS = "CASE WHEN event_type IN ('click', 'view') THEN 'PUT' WHEN event_type = 'purchase' THEN 'EVICT' ELSE 'GET' END"
LIFETIMES_SQL = f"""WITH e AS (SELECT user_id::VARCHAR AS key, ts AS moment, event_id AS id, {KINDS} AS kind FROM events),
 n AS (SELECT *, sum((kind <> 'GET')::INT) OVER w AS entry FROM e WINDOW w AS (PARTITION BY key ORDER BY moment, id ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT key, entry, id, moment, kind, lead(moment) OVER w AS next_at, lead(kind) OVER w AS next_kind FROM n WHERE kind <> 'GET' WINDOW w AS (PARTITION BY key ORDER BY moment, id)),
 p AS (SELECT *, moment + INTERVAL 6 HOUR AS expiry, coalesce(next_at < moment + INTERVAL 6 HOUR, false) AS cut FROM c WHERE kind = 'PUT'),
 r AS (SELECT p.key, p.id, count(*) AS reads FROM p JOIN n ON n.key = p.key AND n.entry = p.entry AND n.kind = 'GET' AND n.moment < p.expiry GROUP BY ALL)
SELECT p.key, p.id AS entry_id, epoch_us(p.moment) AS put_us, epoch_us(CASE WHEN cut THEN next_at ELSE expiry END) AS ended_us, CASE WHEN NOT cut THEN 'EXPIRED' WHEN next_kind = 'PUT' THEN 'REPLACED' ELSE 'EVICTED' END AS reason, coalesce(reads, 0) AS reads
FROM p LEFT JOIN r ON r.key = p.key AND r.id = p.id WHERE CASE WHEN cut THEN next_at ELSE expiry END < (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"""


def _events(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.expr(KINDS).alias("kind"))


def _in_us(rows: DataFrame) -> DataFrame:
    return rows.select("key", "entry_id", F.unix_micros("put_at").alias("put_us"), F.unix_micros("ended_at").alias("ended_us"), "reason", "reads")


@query(LIFETIMES_SQL)
def entry_lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    """Entries that ended by the watermark, from the events as a stream with timers."""
    path, out = f"{sf}/events.parquet", _fresh(spark, "lifetimes")
    rows = _events(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]"))
    ended = expiry.lifetimes(rows, 6 * 3600)
    ended.writeStream.format("parquet").option("path", out).option("checkpointLocation", _fresh(spark, "progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _in_us(spark.read.schema(expiry.ENDED).parquet(out))


@query(LIFETIMES_SQL)
def entry_lifetimes_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the table at once."""
    events = table(spark, sf, "events")
    until = events.agg((F.date_trunc("millisecond", F.max(F.col("ts").cast("timestamp"))) - F.expr("INTERVAL 10 MINUTES")).alias("u")).first().u
    return _in_us(expiry.lifetimes_until(_events(events), 6 * 3600, F.lit(until)))


PLAN_NEEDS = "SELECT source_id AS plan_id, concept_id AS task_id, depends AS needs FROM {a} WHERE depends <> '' UNION SELECT source_id, concept_id, {target} FROM {a} WHERE link <> ''"
PLAN_SQL = f"""WITH RECURSIVE {sql_views("articles")}, needs AS ({PLAN_NEEDS.format(a='articles', target="string_split(string_split(link, '|')[1], '#')[1]")}),
 tasks AS (SELECT source_id AS plan_id, concept_id AS task_id, n_chars AS cost, doc_id % 3 AS priority FROM articles),
 inner_ AS (SELECT n.* FROM needs n JOIN tasks t ON t.plan_id = n.plan_id AND t.task_id = n.needs),
 reach AS (SELECT plan_id, task_id, needs FROM inner_ UNION SELECT r.plan_id, r.task_id, i.needs FROM reach r JOIN inner_ i ON i.plan_id = r.plan_id AND i.task_id = r.needs),
 cycles AS (SELECT DISTINCT plan_id, task_id FROM reach WHERE task_id = needs),
 stuck AS (SELECT * FROM cycles UNION SELECT r.plan_id, r.task_id FROM reach r JOIN cycles c ON c.plan_id = r.plan_id AND c.task_id = r.needs),
 free AS (SELECT * FROM inner_ WHERE (plan_id, task_id) NOT IN (SELECT (plan_id, task_id) FROM stuck)),
 deep AS (SELECT plan_id, task_id, 1 AS layer FROM tasks WHERE (plan_id, task_id) NOT IN (SELECT (plan_id, task_id) FROM stuck) UNION SELECT f.plan_id, f.task_id, d.layer + 1 FROM deep d JOIN free f ON f.plan_id = d.plan_id AND f.needs = d.task_id),
 laid AS (SELECT t.plan_id, t.task_id, t.cost, t.priority, max(layer)::INT AS layer FROM tasks t LEFT JOIN deep d ON d.plan_id = t.plan_id AND d.task_id = t.task_id GROUP BY ALL),
 away AS (SELECT n.plan_id, n.task_id, count(DISTINCT n.needs) AS missing FROM needs n LEFT JOIN tasks t ON t.plan_id = n.plan_id AND t.task_id = n.needs WHERE t.task_id IS NULL GROUP BY ALL),
 placed AS (SELECT *, row_number() OVER w AS place, sum(cost) OVER w AS spent FROM laid WINDOW w AS (PARTITION BY plan_id ORDER BY layer NULLS LAST, priority, task_id ROWS UNBOUNDED PRECEDING))
SELECT p.plan_id, p.task_id, layer, CASE WHEN layer IS NULL THEN 'BLOCKED' WHEN layer = 1 THEN 'READY' ELSE 'WAITING' END AS status, coalesce(missing, 0)::INT AS missing, place::INT AS place, spent::BIGINT AS spent,
 CASE WHEN layer IS NULL THEN 'BLOCKED' WHEN spent <= 150000 THEN 'DO' ELSE 'DEFER' END AS decision FROM placed p LEFT JOIN away a ON a.plan_id = p.plan_id AND a.task_id = p.task_id"""


@query(PLAN_SQL)
def layered_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The articles of each source in the layers in which they can be compiled, within a budget of characters."""
    a = view(spark, sf, "articles")
    needs = spark.sql(PLAN_NEEDS.replace("{target}", "split(split(link, '[|]')[0], '#')[0]"), a=a)
    planned = planning.layers(a.select(F.col("source_id").alias("plan_id"), F.col("concept_id").alias("task_id")), needs)
    costs = a.select(F.col("source_id").alias("plan_id"), F.col("concept_id").alias("task_id"), F.expr("doc_id % 3").alias("priority"), F.col("n_chars").alias("cost"))
    found = planning.budgeted(planned, costs, a.select(F.col("source_id").alias("plan_id"), F.lit(150_000).alias("budget")).distinct())
    return found.withColumn("missing", F.size("missing"))


LETTERS = r"\p{L}+"


@query("""WITH r AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+')) AS run FROM documents), s AS (SELECT run, count(*) AS times FROM r GROUP BY 1),
p AS (SELECT run, times, unnest(range(1, length(run) + 1)) AS place FROM s), g AS (SELECT substr(run, place, k) AS word, sum(times)::HUGEINT AS n FROM p, (VALUES (1), (2), (3), (4)) v(k) WHERE place + k - 1 <= length(run) GROUP BY 1),
t AS (SELECT sum(n) AS total FROM g WHERE length(word) = 1)
SELECT word, n::BIGINT AS n FROM g WHERE length(word) = 1 UNION ALL SELECT w.word, w.n::BIGINT FROM g w, t WHERE length(w.word) > 1 AND w.n >= 5
 AND NOT EXISTS (SELECT 1 FROM (VALUES (1), (2), (3)) v(k), g a, g b WHERE k < length(w.word) AND a.word = left(w.word, k) AND b.word = substr(w.word, k + 1) AND w.n * t.total < 20 * a.n * b.n)""")
def word_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Character n-grams of all documents that hold together, with their counts, and all single letters."""
    docs = table(spark, sf, "documents").select(F.lower("text").alias("text"))
    return segment.learn(docs, "text", LETTERS)


@query()
def segmented_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn of the conversations, written without blanks, cut into words by the counts of the documents' words; the tests hold it against a plain programme."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({LETTERS})"), 1)).alias("word"))
    lexicon = words.groupBy("word").agg(F.count("*").alias("n"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({LETTERS})"), 1), "").alias("run"))
    found = turns.join(segment.segment(turns, lexicon, longest=12), "run", "left")
    return found.select("conv_id", "turn", F.coalesce(F.size("words"), F.lit(0)).alias("n_words"), F.coalesce(F.array_join("words", " "), F.lit("")).alias("segments"))
