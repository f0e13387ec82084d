"""Ingest and compile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import compile as C
from ..operators import governance as G
from ..operators.adapt import sql_views, table, view
from ..sources import files as S
from .catalogue import query

#: Files with telling names.
NAMED = "id, source_id, lang || '/' || CASE id % 9 WHEN 0 THEN 'overview.md' WHEN 1 THEN 'README.md' WHEN 2 THEN 'architecture.txt' WHEN 3 THEN 'CLAUDE.md' WHEN 4 THEN 'config.yml' WHEN 5 THEN 'pic.png' ELSE 'f' || id || '.txt' END AS path, content, size"
NAMED_SQL = f"{sql_views('files')}, named AS (SELECT {NAMED} FROM files)"


def named(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").selectExpr("id", "source_id", NAMED.split("source_id, ", 1)[1].rsplit(", content", 1)[0], "content", "size")


SCORE_SQL = "CASE " + " ".join(f"WHEN starts_with(name, '{p}')" + (" OR name = 'claude.md'" if p == "readme." else "") + f" THEN {s}" for p, s in V.NAME_SCORES) + " ELSE greatest(10, 50 - length(content) // 10000) END"
RANK_SQL = f"{NAMED_SQL}, scored AS (SELECT *, {SCORE_SQL} AS score FROM (SELECT *, lower(string_split(path, '/')[-1]) AS name FROM named)), placed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, lower(path), path, id)::INT AS place FROM scored)"


def unique(files: DataFrame) -> DataFrame:
    """With the id in the path, so that order within a source is fixed."""
    return files.withColumn("path", F.concat("path", F.lit("#"), F.lpad(F.col("id").cast("string"), 9, "0")))


@query(f"WITH {RANK_SQL} SELECT id, score::INT AS score FROM placed")
def file_rank(spark: SparkSession, sf: str) -> DataFrame:
    return C.ranked_files(named(spark, sf)).select("id", F.col("score").cast("int").alias("score"))


@query(f"WITH {NAMED_SQL} SELECT CASE WHEN path LIKE 'en/%' THEN 'english' ELSE split_part(path, '/', 1) END AS \"group\", count(*) AS files, sum(length(content))::BIGINT AS chars FROM named GROUP BY 1")
def group_sources(spark: SparkSession, sf: str) -> DataFrame:
    return C.groups(named(spark, sf), [("^en/", "english")])


@query(f"WITH {NAMED_SQL} SELECT lower(string_split(path, '.')[-1]) AS extension, count(*) AS n FROM named GROUP BY 1")
def ext_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return C.extension_histogram(named(spark, sf))


@query(f"WITH {NAMED_SQL} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(path), '[^a-z0-9]+')) AS word FROM named) WHERE length(word) >= 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 12")
def top_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_keywords(named(spark, sf))


@query(f"WITH {NAMED_SQL}, f AS (SELECT source_id, path, sha256(content) AS digest, (lower(path) LIKE '%.png')::INT AS b FROM named), g AS (SELECT source_id, count(*) AS files, sha256(array_to_string(list_sort(list(path)), chr(10))) AS path_hash, sha256(array_to_string(list_sort(list(path || ':' || digest)), chr(10))) AS manifest_hash, sum(b) AS b FROM f GROUP BY 1) SELECT source_id, files, path_hash, manifest_hash, CASE WHEN b = 0 THEN 'DOCUMENT' WHEN b * 2 >= files THEN 'ASSET_HEAVY' ELSE 'MIXED' END AS profile FROM g")
def bundle_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return C.fingerprints(named(spark, sf))


BATCH_SQL = f"""{NAMED_SQL.replace("END AS path", "END || '#' || lpad(id::VARCHAR, 9, '0') AS path")}, scored AS (SELECT source_id, path, length(content) AS n, {SCORE_SQL} AS score FROM (SELECT *, lower(string_split(path, '/')[-1]) AS name FROM named)), placed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, lower(path), path) AS place FROM scored),
 fold AS (SELECT source_id, path, place, 0 AS batch, n AS used FROM placed WHERE place = 1 UNION ALL SELECT p.source_id, p.path, p.place, CASE WHEN f.used > 0 AND f.used + p.n > 40000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used > 0 AND f.used + p.n > 40000 THEN p.n ELSE f.used + p.n END FROM fold f JOIN placed p ON p.source_id = f.source_id AND p.place = f.place + 1)"""


@query(f"WITH RECURSIVE {BATCH_SQL} SELECT source_id, path, batch FROM fold")
def batch_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.batches(unique(named(spark, sf)))


@query(f"WITH RECURSIVE {BATCH_SQL} SELECT source_id, batch, sha256(source_id || ':' || batch || ':' || array_to_string(list_sort(list(path)), ':')) AS digest FROM fold GROUP BY 1, 2")
def batch_hash(spark: SparkSession, sf: str) -> DataFrame:
    return C.batch_hash(C.batches(unique(named(spark, sf))))


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts into chunks; checked in the tests against its invariants."""
    return C.chunked(view(spark, sf, "articles"), "article_key", "content")


CONCEPTS = ["doc_id AS position", "CASE WHEN doc_id % 2 = 0 THEN 'Topic ' ELSE 'topic_' END || (doc_id % 60) AS concept_id", "coalesce(text, '') AS title", "source || ' ' || coalesce(text, '') AS description", "source || '/' || (doc_id % 9) AS path", "coalesce(text, '') AS snippet"]


@query(f"""WITH c AS (SELECT *, 'topic-' || (position % 60) AS slug FROM (SELECT {", ".join(CONCEPTS)} FROM documents))
SELECT slug, arg_max(title, (length(title), -position)) AS title, arg_max(description, (length(description), -position)) AS description, array_to_string(list_sort(list_distinct(list(path))), ',') AS paths, count(DISTINCT snippet)::INT AS n_snippets FROM c GROUP BY slug""")
def concept_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").selectExpr(*CONCEPTS)
    m = C.merge_concepts(c.select("position", "concept_id", "title", "description", F.array("path").alias("paths"), F.array("snippet").alias("snippets")))
    return m.select("slug", "title", "description", F.array_join("paths", ",").alias("paths"), F.size("snippets").alias("n_snippets"))


@query("SELECT doc_id % 20 AS source_id, 'p' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'NEW' ELSE 'CHANGED' END AS change FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def changed_sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    new = d.selectExpr("doc_id % 20 AS source_id", "'p' || doc_id AS path", "text", "n_chars AS size", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS format")
    old = d.where("doc_id % 5 != 0").selectExpr("doc_id % 20 AS source_id", "'p' || doc_id AS path", "text", "n_chars AS size", "lang AS format")
    return C.changed_files(new, old)


MARKDOWN_SQL = "m AS (SELECT doc_id, regexp_split_to_array('# ' || lang || chr(10) || coalesce(text, '') || chr(10) || '## Details ' || doc_id || chr(10) || source || chr(10) || '### End' || chr(10) || 'last', '\\r?\\n') AS l FROM documents), t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS text FROM m), h AS (SELECT doc_id, i - 1 AS line, length(regexp_extract(text, '^(#+)', 1)) AS level, trim(regexp_replace(text, '^#+\\s*', '')) AS heading FROM t WHERE regexp_matches(text, '^#{1,6}\\s+\\S')), toc AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS end_line FROM h)"


@query(f"WITH {MARKDOWN_SQL} SELECT doc_id, line::INT AS line, level::INT AS level, heading, end_line::INT AS end_line FROM toc")
def toc(spark: SparkSession, sf: str) -> DataFrame:
    return C.toc(_markdown(spark, sf), "doc_id", "content")


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    nl = F.lit("\n")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), "lang", nl, F.coalesce("text", F.lit("")), F.lit("\n## Details "), F.col("doc_id").cast("string"), nl, "source", F.lit("\n### End\nlast")).alias("content"))


@query(f"WITH {MARKDOWN_SQL}, f AS (SELECT doc_id, min(line) AS line, arg_min(coalesce(end_line, -1), line) AS stop FROM toc WHERE lower(heading) = 'end' GROUP BY 1) SELECT doc_id, array_to_string(l[line + 1 : CASE WHEN stop < 0 THEN len(l) ELSE stop END], chr(10)) AS section FROM f JOIN m USING (doc_id)")
def section_read(spark: SparkSession, sf: str) -> DataFrame:
    return C.section(_markdown(spark, sf), "doc_id", "content", "end")


@query("WITH t AS (SELECT doc_id, '=== A' || chr(10) || coalesce(text, '') || chr(10) AS a, '=== B ' || source AS b FROM documents), p AS (SELECT doc_id, a, b, array_to_string(list_filter([a, b], lambda p: contains(lower(p), 'the') OR contains(lower(p), 'src1')), '') AS part FROM t) SELECT doc_id, substr(CASE WHEN part <> '' THEN part ELSE a || b END, 1, 500) AS part FROM p")
def section_select(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("=== A\n"), F.coalesce("text", F.lit("")), F.lit("\n=== B "), "source").alias("t"))
    return d.select("doc_id", C.select_sections(F.col("t"), ["The", "src1"], 500).alias("part"))


@query("""WITH e AS (SELECT DISTINCT concept_id FROM (SELECT 'c' || doc_id AS concept_id FROM documents WHERE doc_id % 10 = 0))
SELECT 'enhance' AS kind, concept_id FROM e UNION ALL SELECT 'propagate', 'c' || (doc_id + 1) FROM documents d WHERE doc_id % 10 = 0 AND EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = d.doc_id + 1) UNION ALL SELECT 'create', 'new-' || doc_id FROM documents WHERE doc_id % 25 = 0""")
def incremental_plan(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    a = d.select(F.concat(F.lit("c"), "doc_id").alias("concept_id"), F.array(F.concat(F.lit("p"), "doc_id")).alias("paths"))
    hit = d.where("doc_id % 20 = 0").select(F.concat(F.lit("c"), "doc_id").alias("concept_id"), F.array(F.lit("other")).alias("paths"))
    path = d.where("doc_id % 20 = 10").select(F.concat(F.lit("q"), "doc_id").alias("concept_id"), F.array(F.concat(F.lit(" p"), "doc_id")).alias("paths"))
    new = d.where("doc_id % 25 = 0").select(F.concat(F.lit("new-"), "doc_id").alias("concept_id"), F.array(F.lit(" ")).alias("paths"))
    ids = d.select("doc_id")
    links = ids.where("doc_id % 10 = 0").join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id").select(F.concat(F.lit("c"), "doc_id").alias("upstream"), F.concat(F.lit("c"), (F.col("doc_id") + 1).cast("string")).alias("downstream"), F.lit("depends_on").alias("relation"))
    ignored = ids.where("doc_id % 10 = 5").select(F.lit("c0").alias("upstream"), F.concat(F.lit("c"), "doc_id").alias("downstream"), F.lit("related").alias("relation"))
    return C.incremental_plan(hit.unionByName(path).unionByName(new), a, links.unionByName(ignored))


@query("""SELECT 'b' || s_suppkey AS bundle_id, CASE s_suppkey % 5 WHEN 0 THEN 'SKIP' WHEN 1 THEN 'EXISTING_SOURCE_UPDATE' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'AMBIGUOUS' ELSE 'NEW_SOURCE' END AS decision,
 CASE WHEN s_suppkey % 5 <> 4 THEN s_suppkey END AS source_id, CASE s_suppkey % 5 WHEN 0 THEN 170 WHEN 1 THEN 130 WHEN 2 THEN 70 WHEN 3 THEN 50 ELSE 0 END AS best FROM supplier""")
def source_decision(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    sources = s.selectExpr("s_suppkey AS source_id", "s_suppkey AS ordinal", "'code' AS code", "'ACTIVE' AS status", "'UPLOAD' AS type", "s_name AS name", "'ph' || s_suppkey AS path_hash", "'mh' || s_suppkey AS manifest_hash", "array('t' || s_suppkey, 'u' || s_suppkey) AS tops", "'' AS summary")
    bundles = s.selectExpr("'b' || s_suppkey AS bundle_id", "CASE WHEN s_suppkey % 5 IN (0, 1, 2, 3) THEN upper(s_name) ELSE 'other' END AS name", "CASE WHEN s_suppkey % 5 IN (0, 1) THEN 'ph' || s_suppkey ELSE 'none' END AS path_hash", "CASE WHEN s_suppkey % 5 = 0 THEN 'mh' || s_suppkey ELSE 'none' END AS manifest_hash", "CASE s_suppkey % 5 WHEN 0 THEN array('t' || s_suppkey, 'u' || s_suppkey) WHEN 2 THEN array('T' || s_suppkey) ELSE array('zz') END AS tops")
    return C.decide_sources(bundles, sources).select("bundle_id", "decision", "source_id", "best")


@query("""WITH r AS (SELECT s_suppkey, s_suppkey % 5 AS m, TIMESTAMP '2024-01-01' + s_suppkey * INTERVAL 1 HOUR AS asked FROM supplier)
SELECT 'b' || s_suppkey AS bundle_id, CASE WHEN m = 0 THEN 'SKIPPED_NO_CHANGE' WHEN m IN (2, 3) THEN CASE WHEN asked + INTERVAL 7 DAY <= TIMESTAMP '2024-01-10 12:00:00' THEN 'FAILED' ELSE 'WAIT_CONFIRM' END ELSE 'COMPILE_QUEUED' END AS status,
 CASE m WHEN 4 THEN 'CREATE' WHEN 1 THEN 'UPDATE' END AS sync_action, CASE WHEN m IN (2, 3) AND asked + INTERVAL 7 DAY <= TIMESTAMP '2024-01-10 12:00:00' THEN 'WAIT_CONFIRM timed out after 7 days' END AS error FROM r""")
def run_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Where the decisions about bundles take their runs."""
    runs = source_decision(spark, sf).withColumn("requested_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, CAST(substring(bundle_id, 2) AS INT))"))
    return G.route_runs(runs, F.lit("2024-01-10 12:00:00").cast("timestamp")).select("bundle_id", "status", "sync_action", "error")


@query("""SELECT doc_id, source || '/' || lang || '.md,' || source || '/' || doc_id AS sources, lang || '=' || source || ',two words' AS keywords, CASE WHEN doc_id % 2 = 0 THEN 'c' || (doc_id + 1) ELSE '' END AS depends_on, 0::INT AS n_related FROM documents""")
def front_matter_lists(spark: SparkSession, sf: str) -> DataFrame:
    """List fields of front matter in all their forms, before whole texts."""
    d = table(spark, sf, "documents")
    depends = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("depends_on: c"), (F.col("doc_id") + 1).cast("string"))).otherwise("depends_on: []")
    md = F.concat(F.lit("---\nsources:\n  - "), "source", F.lit("/"), "lang", F.lit(".md\n  - '"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("'\nreferential_keywords: ["), "lang", F.lit("="), "source", F.lit(', "two words", ]\n'), depends, F.lit("\n---\nrelated: [x]\n"), F.coalesce("text", F.lit("")))
    joined = lambda name: F.array_join(T.front_matter_list(md, name), ",")
    return d.select("doc_id", joined("sources").alias("sources"), joined("referential_keywords").alias("keywords"), joined("depends_on").alias("depends_on"), F.size(T.front_matter_list(md, "related")).alias("n_related"))


@query("SELECT doc_id, 'topic-' || lang || '-x1' AS slug, 'a-' || doc_id || '-b' AS ascii, 'Topic ' || CASE lang WHEN 'en' THEN 'En' WHEN 'fr' THEN 'Fr' WHEN 'de' THEN 'De' WHEN 'es' THEN 'Es' ELSE upper(lang[1]) || lang[2:] END || ' X1' AS title, 'dir/' || doc_id || '.md' AS path, 'target' AS link, (length(text) - length(replace(text, 'the', ''))) // 3 AS occurrences FROM documents")
def scalar_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    slug = T.concept_slug(F.concat(F.lit("  Topic "), "lang", F.lit("__X1!")))
    return d.select("doc_id", slug.alias("slug"), T.ascii_slug(F.concat(F.lit("-A "), F.col("doc_id").cast("string"), F.lit(" éB "))).alias("ascii"), T.slug_title(slug).alias("title"), T.path_key(F.concat(F.lit(" dir\\"), F.col("doc_id").cast("string"), F.lit(".md#x"))).alias("path"), T.wiki_target(F.lit(" target #h|label")).alias("link"), T.occurrences(F.col("text"), "the").alias("occurrences"))


@query("SELECT doc_id, lang || '=' || source || ' ' || (1000 + doc_id % 9000) AS keywords, 'v' || doc_id AS title, 'review_status: passed' AS status FROM documents")
def front_matter_and_keywords(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    code = (F.lit(1000) + F.col("doc_id") % 9000).cast("string")
    text = F.concat("lang", F.lit("="), "source", F.lit(" and "), code, F.lit(" "), code, F.lit(" 12 123456"))
    md = F.concat(F.lit("---\ntitle: v"), F.col("doc_id").cast("string"), F.lit("\nreview_status: pending\n---\n# x\ntitle: other"))
    return d.select("doc_id", F.array_join(T.referential_keywords(text), " ").alias("keywords"), T.front_matter(md, "title").alias("title"), F.concat(F.lit("review_status: "), T.front_matter(T.with_review_status(md, F.lit("passed")), "review_status")).alias("status"))


@query("WITH c AS (SELECT doc_id, lang || '=' || source AS k FROM documents) SELECT 'c' || doc_id AS concept_id, CASE WHEN doc_id % 2 = 0 THEN 'a,b,p' || doc_id ELSE 'a,b' END AS paths, CASE WHEN doc_id % 2 = 0 THEN 'x=1,' || k ELSE 'x=1' END AS keywords, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'added' ELSE '' END ELSE 'old' END AS summary FROM c")
def enhance_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("concept_id")
    a = d.select(name, F.array(F.lit("a"), F.lit("b")).alias("paths"), F.array(F.lit("x=1")).alias("keywords"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("old").alias("summary"))
    b = d.where("doc_id % 2 = 0").select(name, F.array(F.lit("b"), F.concat(F.lit("p"), F.col("doc_id").cast("string"))).alias("paths"), F.concat(F.lit("is "), "lang", F.lit("="), "source", F.lit(" now")).alias("content"), F.lit("added").alias("summary"))
    return C.enhance(a, b).select("concept_id", F.array_join("paths", ",").alias("paths"), F.array_join("keywords", ",").alias("keywords"), "summary")


@query("""SELECT 'g' || doc_id AS "group", CASE WHEN doc_id % 2 = 0 THEN 'k' || doc_id ELSE 'g' || doc_id END AS concept_id, CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE 'G' || doc_id END AS title FROM documents""")
def concept_parse(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('[{"id":"k'), n, F.lit('","title":"T"}]'))).when(F.col("doc_id") % 3 == 0, "[]").otherwise("no json")
    return C.parse_concepts(table(spark, sf, "documents").select(F.concat(F.lit("g"), n).alias("group"), reply.alias("reply"))).select("group", "concept_id", "title")


@query("""SELECT 'g' || doc_id AS "group", 'k' || doc_id AS concept_id, 'T ' || lang AS title, source AS description FROM documents UNION ALL SELECT 'g' || doc_id, 'm' || doc_id, 'm' || doc_id, '' FROM documents WHERE length(source) % 2 = 0""")
def concept_salvage(spark: SparkSession, sf: str) -> DataFrame:
    """Whole objects of fenced replies, of which some break off within their second object."""
    n = F.col("doc_id").cast("string")
    whole = F.concat(F.lit('{"concepts": [{"id":"k'), n, F.lit('","title":"T '), "lang", F.lit('","description":"'), "source", F.lit('"}, {"id":"m'), n, F.lit('"'))
    reply = F.when(F.length("source") % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("}]}\n```"))).otherwise(F.concat(whole, F.lit(',"title":"x')))
    return C.salvage(table(spark, sf, "documents").select(F.concat(F.lit("g"), n).alias("group"), reply.alias("reply")))


@query("""SELECT doc_id, '---' || chr(10) || 'title: ' || lang || chr(10) || 'sources:' || chr(10) || '  - ' || source || chr(10) || 'review_status: pending' || chr(10) || '---' || chr(10) || chr(10) || '# ' || lang || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '- ' || source AS article, substr(coalesce(text, ''), 1, greatest(0, 4000 - length(lang) - 200)) AS prompt FROM documents""")
def fallback_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles written without a generator, and prompts cut to their room."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", C.fallback_article(F.col("lang"), text, F.array("source"), F.array("source")).alias("article"), T.prompt_cut(text, F.col("lang"), 4000).alias("prompt"))


ROUTE_SQL = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in group)}) THEN '{name}'" for group, name in ((S.TEXT, "TEXT"), (S.DOCUMENT, "NATIVE"), (S.IMAGE, "IMAGE"))) + " ELSE 'NONE' END"


@query(f"WITH {NAMED_SQL}, e AS (SELECT id, path, lower(string_split(path, '.')[-1]) AS ext FROM named) SELECT id, {ROUTE_SQL} AS route, CASE WHEN {ROUTE_SQL} = 'IMAGE' THEN '[Image file: ' || path || ']' END AS placeholder FROM e")
def file_routes(spark: SparkSession, sf: str) -> DataFrame:
    """How each file is read, and what stands for images."""
    rows = named(spark, sf).withColumn("route", S.route(F.lower(F.substring_index("path", ".", -1))))
    return rows.select("id", "route", F.when(F.col("route") == "IMAGE", S.placeholder(F.col("path"))).alias("placeholder"))


@query()
def folder_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The files of the input folder in a fixed order, contents left unread; checked in the tests."""
    return S.scan(spark, sf, ["parquet"]).select("path", "extension", "size").orderBy("path")
