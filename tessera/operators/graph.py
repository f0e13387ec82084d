"""Dependency edges, impact propagation, entity search with facts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NULL_SCOPE = -1


def edges(articles: DataFrame) -> DataFrame:
    """upstream, downstream, relation (article keys): depends_on, related in both directions, wiki links; each once, none to itself.

    Articles: article_key, concept_id, source_id, ordinal, depends_on, related, content. A reference resolves within its
    source, by concept id or key; of articles that share it the last (largest ordinal) counts.
    """
    scope = F.coalesce("source_id", F.lit(NULL_SCOPE))
    names = articles.select(scope.alias("scope"), "ordinal", "article_key", F.explode(F.array("concept_id", "article_key")).alias("ref")).where("ref is not null and ref != ''")
    target = names.groupBy("scope", "ref").agg(F.max_by("article_key", "ordinal").alias("target"))
    base = articles.select(scope.alias("scope"), "article_key", "depends_on", "related", "content")
    links = F.transform(T.found(F.col("content"), r"\[\[([^\]]+)\]\]", 1), T.wiki_target)
    each = [("depends_on", F.col("depends_on")), ("related", F.col("related")), ("wiki_link", links)]
    refs = None
    for relation, values in each:
        part = base.select("scope", "article_key", F.lit(relation).alias("relation"), F.explode(values).alias("ref"))
        refs = part if refs is None else refs.unionByName(part)
    found = refs.where("ref != ''").join(target, ["scope", "ref"]).where("target != article_key").select(F.col("target").alias("upstream"), F.col("article_key").alias("downstream"), "relation")
    back = found.where("relation = 'related'").select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), "relation")
    return found.unionByName(back).distinct()


def impact(links: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth, relation: what each root (column root) reaches downstream, at its smallest depth, and the (alphabetically first) relation of the edges that reach it there; roots themselves left out.

    A frontier join per level with an anti-join against what has been seen, until a level is empty; every level is written
    out so that lineage stays short and lost executors cost one level, and what has been seen is written anew after every
    sixteenth so that its plan stays short on deep chains.
    """
    from .common import cut

    links = links.select("upstream", "downstream", F.col("relation") if "relation" in links.columns else F.lit(None).cast("string").alias("relation")).distinct()
    seen = cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation")).distinct())
    frontier = seen
    for depth in count(1):
        step = frontier.select("root", "node").join(links, F.col("node") == links.upstream).groupBy("root", F.col("downstream").alias("node")).agg(F.min("relation").alias("relation"))
        frontier = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth"), "relation"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            seen = cut(seen)
    return seen.where("depth > 0")


def facts_block(entities: DataFrame, facts: DataFrame, relations: DataFrame, most: int = 6, least: float = 0.0) -> DataFrame:
    """entity_id, block: the entity, its most certain facts and its edges (of a confidence of ``least`` or more) as one line."""

    def listed(rows: DataFrame, text) -> DataFrame:
        w = Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "id")
        first = rows.where("NOT tombstoned AND superseded_by IS NULL").where(F.col("confidence") >= least).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("t")))), lambda s: s["t"])
        return first.groupBy("entity_id").agg(F.array_join(ordered, "").alias("text"))

    f = listed(facts, F.concat(F.lit("；"), "predicate", F.lit("="), "value")).withColumnRenamed("text", "facts")
    r = listed(relations, F.concat(F.lit("；"), "edge_type", F.lit("->"), "dst")).withColumnRenamed("text", "edges")
    rows = entities.join(f, "entity_id", "left").join(r, "entity_id", "left")
    return rows.select("entity_id", F.concat(F.lit("实体="), "canonical_name", F.coalesce("facts", F.lit("")), F.coalesce("edges", F.lit(""))).alias("block"))


def entity_search(questions: DataFrame, entities: DataFrame, blocks: DataFrame | Callable[[DataFrame], DataFrame], limit: int = 5) -> DataFrame:
    """question_id, entity_id, score, rank: entities whose name holds a token, the first ``max(2 limit, 8)`` by name, then scored by names and facts.

    blocks: entity_id, block of all entities, or a function that gives them for some (entity_id), so that the facts of others
    aren't sorted. Questions of one text have the same entities and are searched once.
    """
    from .common import cut
    from .retrieval import first_holders, top_k

    texts = cut(questions.select("question").distinct().select("question", F.monotonically_increasing_id().alias("asked"), T.tokens(F.col("question")).alias("tokens")))
    tokens = texts.select(F.col("asked").alias("question_id"), F.explode("tokens").alias("token"))
    names = entities.select("entity_id", F.lower("simple_name").alias("simple"), F.lower("canonical_name").alias("canonical"), "simple_name", "unresolved")
    short = names.select(F.col("entity_id").alias("id"), F.coalesce("simple", F.lit("")).alias("simple"), F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("simple_name", F.lit("")).alias("simple_name"))
    first = cut(first_holders(short, tokens, ["simple", "canonical"], "simple_name", max(2 * limit, 8)).select("question_id", F.col("id").alias("entity_id")))
    if callable(blocks):
        blocks = blocks(cut(first.select("entity_id").distinct()))
    full = first.join(names, "entity_id").join(blocks, "entity_id").join(tokens, "question_id")
    hit = lambda c, x: F.when(F.contains(c, F.col("token")), x).otherwise(0.0)
    scored = full.groupBy("question_id", "entity_id", "unresolved").agg(F.sum(hit(F.col("simple"), 3.0) + hit(F.col("canonical"), 2.5) + hit(F.lower("block"), 1.0)).alias("s"))
    scored = scored.select("question_id", "entity_id", F.round(F.when(F.col("unresolved"), F.col("s") * 0.6).otherwise(F.col("s")), 9).alias("score")).where("score > 0")
    best = top_k(scored, limit, "entity_id").withColumnRenamed("question_id", "asked")
    return questions.where("question_id is not null").join(texts.join(best, "asked"), "question").select("question_id", "entity_id", "score", "rank")


def link_targets(articles: DataFrame) -> DataFrame:
    """article_key, target, resolved: every wiki link, resolved by concept id, else by the title's slug."""
    links = articles.select("article_key", F.explode(F.transform(T.found(F.col("content"), r"\[\[([^\]]+)\]\]", 1), T.wiki_target)).alias("target"))
    ids = articles.select(F.col("concept_id").alias("target"), F.col("concept_id").alias("by_id")).distinct()
    slug = T.concept_slug(F.col("title"))
    titles = articles.groupBy(slug.alias("slug")).agg(F.min("concept_id").alias("by_title"))
    return links.join(ids, "target", "left").withColumn("slug", T.concept_slug(F.col("target"))).join(titles, "slug", "left").select("article_key", "target", F.coalesce("by_id", "by_title").alias("resolved"))


CORRECTION = "array<struct<`from`:string,note:string>>"


def mark_downstream(articles: DataFrame, marks: DataFrame) -> DataFrame:
    """Articles (concept_id, corrections: JSON array) with a correction appended for each mark (concept_id, upstream, note) that isn't there yet."""
    new = marks.groupBy("concept_id").agg(F.array_sort(F.collect_set(F.struct(F.col("upstream").alias("from"), "note"))).alias("_new"))
    rows = articles.join(new, "concept_id", "left")
    add = F.aggregate("_new", F.coalesce("corrections", F.lit("[]")), lambda a, e: F.when(T.json_has(a, CORRECTION, "from", e["from"]), a).otherwise(T.json_append(a, e)))
    return rows.withColumn("corrections", F.when(F.col("_new").isNull(), F.col("corrections")).otherwise(add)).drop("_new")


def clear_upstream(articles: DataFrame, cleared: DataFrame) -> DataFrame:
    """Articles without the corrections that come from the cleared upstream articles (concept_id, upstream)."""
    gone = cleared.groupBy("concept_id").agg(F.collect_set("upstream").alias("_gone"))
    rows = articles.join(gone, "concept_id", "left")
    left = F.aggregate("_gone", F.coalesce("corrections", F.lit("[]")), lambda a, u: T.json_remove(a, "from", u))
    return rows.withColumn("corrections", F.when(F.col("_gone").isNull(), F.col("corrections")).otherwise(left)).drop("_gone")


def repair_links(articles: DataFrame) -> DataFrame:
    """article_key, content, fixed, unresolved of articles (article_key, concept_id, title, content): a wiki link that is no concept id but a title becomes that title's concept id, with its anchor and label kept."""
    links = articles.select("article_key", F.posexplode(T.found(F.col("content"), r"\[\[([^\]]+)\]\]", 1)).alias("place", "raw")).withColumn("target", T.wiki_target(F.col("raw")))
    ids = articles.select(F.col("concept_id").alias("target"), F.lit(True).alias("known")).distinct()
    slug = lambda c: T.concept_slug(F.col(c))
    titles = articles.groupBy(slug("title").alias("slug")).agg(F.min("concept_id").alias("by_title"))
    found = links.join(ids, "target", "left").withColumn("slug", slug("target")).join(titles, "slug", "left")
    rest = F.substring("raw", F.length(F.regexp_extract("raw", r"^[^|#]*", 0)) + 1, F.length("raw"))
    fixed = F.col("known").isNull() & F.col("by_title").isNotNull()
    new = F.when(fixed, F.concat("by_title", rest)).otherwise(F.col("raw"))
    per = found.groupBy("article_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", new.alias("new")))), lambda s: s["new"]).alias("_new"),
        F.count_if(fixed).alias("fixed"),
        F.array_sort(F.collect_set(F.when(F.col("known").isNull() & F.col("by_title").isNull(), F.col("target")))).alias("unresolved"),
    )
    gaps = F.split("content", r"\[\[[^\]]+\]\]", -1)
    text = F.array_join(F.zip_with(gaps, F.transform("_new", lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    rows = articles.join(per, "article_key", "left")
    return rows.select("article_key", F.when(F.col("_new").isNull(), F.col("content")).otherwise(text).alias("content"), F.coalesce("fixed", F.lit(0)).cast("long").alias("fixed"), F.coalesce("unresolved", F.array().cast("array<string>")).alias("unresolved"))


def link_totals(targets: DataFrame) -> DataFrame:
    return targets.agg(F.count("*").alias("links"), F.count("resolved").alias("resolved"), F.sum(F.col("resolved").isNull().cast("long")).alias("unresolved"), F.count_distinct("article_key").alias("articles"))
