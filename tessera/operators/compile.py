"""From source files to articles: ranking, grouping, batches, chunks, sections, concept merge, incremental plans, source matching."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


def file_score(path: Column, content: Column, rules: list[tuple[str, int]] = ()) -> Column:
    """How early a file is read: configured name patterns (regular expressions), known names, else by length."""
    name = F.lower(F.substring_index(path, "/", -1))
    out = F.when(F.lit(False), 0)
    for pattern, score in rules:
        out = out.when(name.rlike(pattern), score)
    for prefix, score in V.NAME_SCORES:
        test = name.startswith(prefix)
        out = out.when(test | (name == "claude.md") if prefix == "readme." else test, score)
    return out.otherwise(F.greatest(F.lit(10), F.lit(50) - F.floor(F.length(F.coalesce(content, F.lit(""))) / 10000).cast("int")))


def ranked_files(files: DataFrame, rules: list[tuple[str, int]] = ()) -> DataFrame:
    """Adds score and place within each source, best first, ties by path."""
    scored = files.withColumn("score", file_score(F.col("path"), F.col("content"), rules))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), F.lower("path"), "path")))


def group_key(path: Column, rules: list[tuple[str, str]] = ()) -> Column:
    """The group of a file: a rule (path pattern, group), else the first folder, else the file's stem."""
    out = F.when(F.lit(False), "")
    for pattern, key in rules:
        out = out.when(path.rlike(pattern), key)
    stem = F.regexp_extract(path, r"^(.+)\.[^.]*$", 1)
    return out.when(path.contains("/"), F.substring_index(path, "/", 1)).when(stem != "", stem).otherwise(path)


def groups(files: DataFrame, rules: list[tuple[str, str]] = ()) -> DataFrame:
    return files.groupBy(group_key(F.col("path"), rules).alias("group")).agg(F.count("*").alias("files"), F.sum(F.length("content")).alias("chars"))


def batches(files: DataFrame, most: int = 40_000) -> DataFrame:
    """source_id, path, batch: files of a source in their order, a new batch where the characters would exceed ``most``. One pass over each source's sorted lengths (not its texts), which holds a running sum alone."""
    ordered = files.select("source_id", "path", file_score(F.col("path"), F.col("content")).alias("score"), F.lower("path").alias("low"), F.length("content").alias("n"))
    sorted_ = ordered.repartition("source_id").sortWithinPartitions("source_id", F.desc("score"), "low", "path").select("source_id", "path", "n")

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, batch, used = None, 0, 0
        for frame in frames:
            out = []
            for s, n in zip(frame["source_id"], frame["n"], strict=True):
                if s != source:
                    source, batch, used = s, 0, 0
                if used > 0 and used + n > most:
                    batch, used = batch + 1, 0
                used += n
                out.append(batch)
            yield pd.DataFrame({"source_id": frame["source_id"], "path": frame["path"], "batch": out})

    return sorted_.mapInPandas(numbered, f"source_id {files.schema['source_id'].dataType.simpleString()}, path string, batch int")


def batch_hash(rows: DataFrame) -> DataFrame:
    """source_id, batch, digest of source, number and paths. A batch holds at most so many characters of text, so its paths are few."""
    joined = F.array_join(F.array_sort(F.collect_list("path")), ":")
    return rows.groupBy("source_id", "batch").agg(F.sha2(F.concat_ws(":", F.first("source_id").cast("string"), F.first("batch").cast("string"), joined), 256).alias("digest"))


def extension_histogram(files: DataFrame) -> DataFrame:
    ext = F.when(F.col("path").contains("."), F.lower(F.substring_index("path", ".", -1))).otherwise("(none)")
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("n"))


def top_keywords(files: DataFrame, most: int = 12) -> DataFrame:
    words = files.select(F.explode(F.split(F.lower("path"), "[^a-z0-9]+")).alias("word")).where("length(word) >= 3")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def fingerprints(files: DataFrame) -> DataFrame:
    """source_id, files, path_hash, manifest_hash, profile. Each file's own hash is taken before the shuffle; a source's sorted lines then pass through two running hashes, so none is gathered."""
    rows = files.select("source_id", "path", F.sha2("content", 256).alias("digest"), T.ends_with_any(F.lower("path"), V.BINARY_ENDINGS).cast("long").alias("binary"))
    counts = rows.groupBy("source_id").agg(F.count("*").alias("files"), F.sum("binary").alias("binary"))

    def hashed(column: str, name: str) -> DataFrame:
        lines = rows.select("source_id", F.col("path") if column == "path" else F.concat_ws(":", "path", "digest")).toDF("source_id", "line")
        kind = f"source_id {files.schema['source_id'].dataType.simpleString()}, {name} string"
        return lines.repartition("source_id").sortWithinPartitions("source_id", "line").mapInPandas(_running_hash(name), kind)

    out = counts.join(hashed("path", "path_hash"), "source_id").join(hashed("digest", "manifest_hash"), "source_id")
    return out.select("source_id", "files", "path_hash", "manifest_hash", T.content_profile(F.col("files"), F.col("binary")).alias("profile"))


def _running_hash(name: str):
    """The SHA-256 of each source's lines, which come sorted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, h = None, None
        for frame in frames:
            done = []
            for s, line in zip(frame["source_id"], frame["line"], strict=True):
                if h is None or s != source:
                    if h is not None:
                        done.append((source, h.hexdigest()))
                    source, h = s, hashlib.sha256(line.encode())
                else:
                    h.update(b"\n" + line.encode())
            yield pd.DataFrame(done, columns=["source_id", name])
        if h is not None:
            yield pd.DataFrame([(source, h.hexdigest())], columns=["source_id", name])

    return run


ORDERED = re.compile(r"\d+\.\s+.*")
BREAK = re.compile("\r\n|[\n\v\f\r\x85\u2028\u2029]")


def units(text: str) -> list[tuple[str, int]]:
    """Units of a text with their offsets: a heading or list item begins one, a blank line ends one, a fenced block is one."""
    out: list[tuple[str, int]] = []
    held, start, at, fenced = [], 0, 0, False

    def close() -> None:
        whole = "".join(held)
        if whole.strip():
            out.append((whole, start))
        held.clear()

    for line in BREAK.split(text or ""):
        bare, fence = line.strip(), line.strip().startswith("```")
        heads = bare.startswith(("#", "---", "- ", "* ")) or ORDERED.fullmatch(bare)
        if fenced:
            held.append(line + "\n")
            if fence:
                fenced = False
                close()
        elif fence or heads:
            close()
            start = at
            held.append(line + "\n")
            fenced = fence
        elif not bare:
            held.append(line + "\n")
            close()
        else:
            start = start if held else at
            held.append(line + "\n")
        at += len(line) + 1
    close()
    return out


def chunks(text: str, most: int = 3600, overlap: float = 0.15) -> list[tuple[str, int]]:
    """Chunks of whole units up to ``most`` characters; the next one goes back over the units that make up the overlap and always advances."""
    parts = units(text)
    back = int(most * overlap + 0.5)
    out, i = [], 0
    while i < len(parts):
        first, held, size = i, [], 0
        while i < len(parts) and not (held and size + len(parts[i][0]) > most):
            held.append(parts[i][0])
            size += len(parts[i][0])
            i += 1
        out.append(("".join(held).strip(), parts[first][1]))
        if i < len(parts) and back:
            seen, to = 0, i
            while to > first and seen < back:
                to -= 1
                seen += len(parts[to][0])
            i = max(first + 1, to)
    return out


def chunked(rows: DataFrame, key: str, column: str, most: int = 3600, overlap: float = 0.15, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, chunk_index, char_offset, chunk of every row, and the columns to keep; texts travel in Arrow batches, no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, i, at, c, *more) for k, text, *more in zip(frame[key], frame[column], *(frame[c] for c in keep), strict=True) for i, (c, at) in enumerate(chunks(text, most, overlap))]
            yield pd.DataFrame(out, columns=[key, "chunk_index", "char_offset", "chunk", *keep])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.select(key, column, *keep).mapInPandas(run, ", ".join([f"{key} {kind(key)}, chunk_index int, char_offset long, chunk string", *(f"{c} {kind(c)}" for c in keep)]))


def replace_chunks(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old chunks with those of the new rows' keys replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def merge_concepts(concepts: DataFrame) -> DataFrame:
    """One row per concept slug: the longest title and description (the first of equals), all paths in order, snippets as first seen. concepts: position, concept_id, title, description, paths, snippets."""
    longest = lambda c: F.max_by(c, F.struct(F.length(F.coalesce(c, F.lit(""))), -F.col("position")))
    rows = concepts.withColumn("slug", T.concept_slug(F.col("concept_id")))

    def first_seen(c: str, order: list) -> DataFrame:
        """slug, c: the different values of the lists, each told apart before they are gathered."""
        each = rows.select("slug", "position", F.posexplode(c).alias("_i", "_v")).groupBy("slug", "_v").agg(F.min(F.struct("position", "_i")).alias("_at"))
        return each.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda s: s["_v"]).alias(c))

    one = rows.groupBy("slug").agg(longest(F.col("title")).alias("title"), longest(F.col("description")).alias("description"))
    out = one.join(first_seen("paths", ["_v"]), "slug", "left").join(first_seen("snippets", ["_at", "_v"]), "slug", "left")
    none = F.array().cast("array<string>")
    return out.select("slug", "title", "description", F.coalesce("paths", none).alias("paths"), F.coalesce("snippets", none).alias("snippets"))


def toc(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, line, level, heading, end_line of every markdown heading; a section ends before the next heading of any level."""
    lines = rows.select(key, F.posexplode(F.split(column, "\r?\n")).alias("line", "text"))
    heads = lines.where(F.col("text").rlike(r"^#{1,6}\s+\S")).select(key, "line", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("text", r"^#+\s*", "")).alias("heading"))
    return heads.withColumn("end_line", F.lead("line").over(Window.partitionBy(key).orderBy("line")))


def section(rows: DataFrame, key: str, column: str, heading: str) -> DataFrame:
    """key, section: the lines of the first section with that heading."""
    found = toc(rows, key, column).where(F.lower("heading") == heading.lower())
    first = found.groupBy(key).agg(F.min_by(F.struct("line", "end_line"), "line").alias("s"))
    lines = F.split(column, "\r?\n")
    last = F.coalesce(F.col("s.end_line"), F.size(lines))
    return rows.join(first, key).select(key, F.array_join(F.slice(lines, F.col("s.line") + 1, last - F.col("s.line")), "\n").alias("section"))


def select_sections(text: Column, terms: list[str], budget: int) -> Column:
    """The parts that begin with a ``=== `` line and hold one of the terms, up to a budget of characters; the text's start if none does."""
    parts = F.filter(F.split(text, r"(?m)^(?==== )"), lambda p: p.startswith("=== ") & T.any_of(F.lower(p), [t.lower() for t in terms]))
    return F.substring(F.when(F.size(parts) > 0, F.array_join(parts, "")).otherwise(text), 1, budget)


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """source_id, path, change (NEW or CHANGED) of files that differ from the stored ones in any field."""
    fields = [c for c in new.columns if c not in ("source_id", "path")]
    had = old.select("source_id", "path", F.lit(True).alias("_had"), *(F.col(c).alias(f"_{c}") for c in fields))
    rows = new.join(had, ["source_id", "path"], "left")
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.where(F.col("_had").isNull() | differs).select("source_id", "path", F.when(F.col("_had").isNull(), "NEW").otherwise("CHANGED").alias("change"))


def incremental_plan(concepts: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """kind, concept_id: existing articles hit directly (same concept or a shared path) or reached downstream are enhanced, concepts without a hit are new."""
    from .graph import impact

    direct = concepts.join(articles.select("concept_id", F.col("concept_id").alias("article")), "concept_id").select("concept_id", "article")
    path = lambda df, c: df.select(F.col("concept_id").alias(c), F.explode(F.filter(F.transform("paths", lambda p: F.trim(p)), lambda p: p != "")).alias("path")).distinct()
    shared = path(concepts, "concept_id").join(path(articles, "article"), "path").select("concept_id", "article")
    hits = direct.unionByName(shared).distinct()
    reached = impact(links.where("relation in ('depends_on', 'wiki_link')"), hits.select(F.col("article").alias("root")).distinct()).select(F.col("node").alias("concept_id")).distinct()
    first = hits.select(F.col("article").alias("concept_id")).distinct()
    new = concepts.select("concept_id").distinct().join(hits.select("concept_id").distinct(), "concept_id", "left_anti")
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "concept_id")
    return kind(first, "enhance").unionByName(kind(reached.join(first, "concept_id", "left_anti"), "propagate")).unionByName(kind(new, "create"))


def enhance(articles: DataFrame, additions: DataFrame) -> DataFrame:
    """concept_id, paths, keywords, summary of articles merged with additions, old values first."""
    add = additions.select("concept_id", F.col("paths").alias("_p"), F.col("content").alias("_c"), F.col("summary").alias("_s"))
    rows = articles.join(add, "concept_id", "left")
    none = F.array().cast("array<string>")
    summary = F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", F.coalesce("_s", F.lit(""))).otherwise(F.col("summary"))
    return rows.select("concept_id", F.array_union("paths", F.coalesce("_p", none)).alias("paths"), F.array_union("keywords", F.coalesce(T.referential_keywords(F.col("_c")), none)).alias("keywords"), summary.alias("summary"))


def fallback_article(title: Column, description: Column, snippets: Column, sources: Column) -> Column:
    """The article written without a generator: front matter, heading, description, snippets as a list."""
    items = F.array_join(F.transform(snippets, lambda s: F.concat(F.lit("- "), s)), "\n")
    listed = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("  - "), s)), "\n")
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("title: "), title), F.lit("sources:"), listed, F.lit("review_status: pending"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), description, F.lit(""), items)


def parse_concepts(replies: DataFrame, schema: str = "array<struct<id:string,title:string,description:string>>") -> DataFrame:
    """group, concept_id, title, description from structured replies (group, reply); one concept per group where a reply doesn't parse."""
    rows = replies.withColumn("parsed", F.from_json("reply", schema))
    usable = F.coalesce(F.size("parsed") > 0, F.lit(False)) & F.coalesce(F.forall("parsed", lambda c: c["id"].isNotNull()), F.lit(False))
    whole = F.array(F.struct(F.col("group").alias("id"), T.slug_title(T.concept_slug(F.col("group"))).alias("title"), F.lit("").alias("description")))
    return rows.select("group", F.explode(F.when(usable, F.col("parsed")).otherwise(whole)).alias("c")).select("group", F.col("c.id").alias("concept_id"), F.coalesce("c.title", "c.id").alias("title"), F.coalesce("c.description", F.lit("")).alias("description"))


def decide_sources(bundles: DataFrame, sources: DataFrame) -> DataFrame:
    """bundle_id, decision, source_id, best, gap. bundles: bundle_id, name, path_hash, manifest_hash, tops; sources: source_id, code, status, type, name, path_hash, manifest_hash, tops, summary, ordinal.

    Candidates meet by equality of something they can score on (name, paths, top-level folders, summary words), so bundles and sources aren't crossed.
    """
    usable = sources.where("code != 'legacy-default' AND status NOT IN ('DISABLED', 'ARCHIVED') AND type = 'UPLOAD'")
    slugs = lambda c: F.transform(c, T.ascii_slug)
    b = bundles.select("bundle_id", T.ascii_slug(F.col("name")).alias("b_name"), F.col("path_hash").alias("b_path"), F.col("manifest_hash").alias("b_manifest"), F.col("tops").alias("b_tops"))
    s = usable.select("source_id", "ordinal", T.ascii_slug(F.col("name")).alias("s_name"), F.col("path_hash").alias("s_path"), F.col("manifest_hash").alias("s_manifest"), F.col("tops").alias("s_tops"), T.ascii_slug(F.col("summary")).alias("s_summary"))
    # blank names, paths and hashes are no keys: they would make all bundles meet all sources
    key = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c))
    keys = lambda side: F.concat(F.array(key("n", F.col(f"{side}_name")), key("p", F.col(f"{side}_path")), key("m", F.col(f"{side}_manifest"))), F.transform(slugs(F.coalesce(F.col(f"{side}_tops"), F.array().cast("array<string>"))), lambda t: key("t", t)))
    keyed = lambda df, side: df.select("*", F.explode(F.array_distinct(F.array_compact(keys(side)))).alias("k"))
    by_key = keyed(b, "b").join(keyed(s, "s"), "k").drop("k")
    # a summary that holds a name: the names as tokens of one automaton, each summary read once
    from .retrieval import holders

    found = holders(s.select(F.col("source_id").alias("id"), "s_summary"), b.where("b_name != ''").select(F.col("bundle_id").alias("question_id"), F.col("b_name").alias("token")), ["s_summary"])
    by_summary = found.toDF("bundle_id", "source_id").join(b, "bundle_id").join(s, "source_id").select(*by_key.columns)
    pairs = by_key.unionByName(by_summary).dropDuplicates(["bundle_id", "source_id"])
    same_tops = (F.size("s_tops") > 0) & (F.col("s_tops") == F.col("b_tops"))
    common = F.size(F.filter(slugs(F.col("s_tops")), lambda t: F.array_contains(slugs(F.col("b_tops")), t)))
    overlap = F.when((F.size("s_tops") == 0) | (F.size("b_tops") == 0), 0.0).otherwise(common / F.greatest(F.size("s_tops"), F.size("b_tops")))
    same_path = (F.coalesce("s_path", F.lit("")) != "") & (F.col("s_path") == F.col("b_path"))
    n = lambda cond, x: F.when(cond, x).otherwise(0)
    score = n((F.col("b_name") != "") & (F.col("b_name") == F.col("s_name")), 50) + n(same_path, 80) + F.when(same_tops, 40).when(overlap >= 0.5, 20).otherwise(0) + n((F.col("s_summary") != "") & F.contains("s_summary", F.col("b_name")), 15)
    scored = pairs.select("bundle_id", "source_id", "ordinal", score.alias("score"), (same_path | same_tops).alias("update"), F.coalesce(F.col("b_manifest") == F.col("s_manifest"), F.lit(False)).alias("same"))
    w = Window.partitionBy("bundle_id").orderBy(F.desc("score"), "ordinal")
    best = scored.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    skip = scored.where("same").groupBy("bundle_id").agg(F.min_by("source_id", "ordinal").alias("skip"))
    rows = bundles.select("bundle_id").join(best.where("n = 1"), "bundle_id", "left").join(skip, "bundle_id", "left")
    gap = F.col("score") - F.coalesce("second", F.lit(0))
    strong = (F.col("score") >= 80) & (gap >= 20)
    decision = F.when(F.col("skip").isNotNull(), "SKIP").when(F.coalesce("score", F.lit(0)) < 40, "NEW_SOURCE").when(strong & F.col("update"), "EXISTING_SOURCE_UPDATE").when(strong, "EXISTING_SOURCE_APPEND").otherwise("AMBIGUOUS")
    source = F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.coalesce("score", F.lit(0)) >= 40, F.col("source_id"))
    return rows.select("bundle_id", decision.alias("decision"), source.alias("source_id"), F.coalesce("score", F.lit(0)).alias("best"), F.coalesce(gap, F.lit(0)).alias("gap"))


def whole_objects(text: str, at: int) -> Iterator[str]:
    """The objects of a JSON array whose first one begins at or after ``at``, as far as they are whole."""
    reader = json.JSONDecoder()
    while (m := re.compile(r"[\s,]*(?=\{)").match(text, at)) is not None:
        try:
            _, end = reader.raw_decode(text, m.end())
        except ValueError:
            return
        yield text[m.end() : end]
        at = end


def salvage(replies: DataFrame) -> DataFrame:
    """group, concept_id, title, description of the whole concept objects that cut-off or fenced replies (group, reply) hold under ``concepts``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for group, text in zip(frame["group"], frame["reply"], strict=True):
                at = text.find('"concepts"')
                begin = text.find("[", at) if at >= 0 else -1
                for raw in whole_objects(text, begin + 1) if begin >= 0 else ():
                    concept = json.loads(raw)
                    if concept.get("id"):
                        out.append((group, str(concept["id"]), str(concept.get("title") or concept["id"]), str(concept.get("description") or "")))
            yield pd.DataFrame(out, columns=["group", "concept_id", "title", "description"])

    return replies.select("group", T.unfenced(F.col("reply")).alias("reply")).mapInPandas(run, "group string, concept_id string, title string, description string")
