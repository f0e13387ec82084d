"""Claims, citations and their validation, evidence ledgers, research findings, answer metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V

# --- fixed values: literals of citations, sections without claims, hard facts -----------------------------------------
ARTICLE = r"\[\[(?!→\s*)([^\]|]+)(?:\|[^\]]+)?\]\]"
SOURCE = r"(?:\[\[→\s*([^,\]]+)(?:,[^\]]+)?\]\]|\[→\s*([^,\]]+)(?:,[^\]]+)?\])"
LINES = r":(?:L)?\d+(?:-(?:L)?\d+)?$"
NO_CLAIMS = ("问题", "分层摘要", "冲突提示", "参考说明")
NUMBER = r"\b(\d+(?:\.\d+)?)\b"
SNAKE = r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+){1,})\b"
QUALIFIED = r"\b(com(?:\.[A-Za-z_][\w$]*){2,})\b"
URL_PATH = r"(/[-A-Za-z0-9_./]+)"
SYMBOL = r"\b([A-Z][A-Za-z0-9]*(?:Mapper|Service|ServiceImpl|Impl|Controller|Dao))\b"
LATIN = r"(?<![A-Za-z0-9_./-])([A-Za-z][A-Za-z0-9-]{2,})(?![A-Za-z0-9_./-])"
LEAST_CONFIDENCE = 0.55

CITATION = "array<struct<literal:string,kind:string,target:string>>"


def citations(text: Column) -> Column:
    """array<struct<literal, kind, target>> of a text's citations: articles first, then source files without line ranges."""
    article = F.transform(T.found(text, ARTICLE), lambda m: F.struct(m.alias("literal"), F.lit("ARTICLE").alias("kind"), F.trim(F.regexp_extract(m, ARTICLE, 1)).alias("target")))

    def source(m: Column) -> Column:
        raw = F.trim(F.concat(F.regexp_extract(m, SOURCE, 1), F.regexp_extract(m, SOURCE, 2)))
        return F.struct(F.concat(F.lit("[→ "), raw, F.lit("]")).alias("literal"), F.lit("SOURCE_FILE").alias("kind"), F.trim(F.regexp_replace(raw, LINES, "")).alias("target"))

    return F.concat(article, F.transform(T.found(text, SOURCE), source))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ARTICLE, ""), SOURCE, ""), r"\s+", " "))


def hard_facts(claim: Column, named: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case literals that evidence must hold. Han terms of three or more characters count beside others if they hold one of the ``named`` words, which are a deployment's own and none by default."""
    c = F.replace(F.replace(F.coalesce(claim, F.lit("")), F.lit("**"), F.lit("")), F.lit("`"), F.lit(""))
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"(?m)^#+\s*", ""), r"(?<=\s|^)\d+\.\s+", ""))
    latin = F.array_distinct(T.lower_all(F.concat(*(T.found(c, p, 1) for p in (NUMBER, SNAKE, QUALIFIED, URL_PATH, SYMBOL, LATIN)))))
    if not named:
        return latin
    han = F.filter(T.found(c, r"\p{IsHan}{3,}"), lambda h: T.any_of(h, list(named)))
    return F.when(F.size(latin) > 0, F.array_distinct(F.concat(latin, han))).otherwise(latin)


def evidence_tokens(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{IsDigit}_./-]+")


def _cited(text: str) -> list[str]:
    return [m.group() for m in re.finditer(ARTICLE, text)] + [f"[→ {(m[1] or m[2]).strip()}]" for m in re.finditer(SOURCE, text)]


def _bare(text: str) -> str:
    return re.sub(r"[\s。；;，,.、:：()（）*-]+", "", re.sub(SOURCE, "", re.sub(ARTICLE, "", text)))


def sentences(block: str) -> list[str]:
    """Claims of a block: sentences, those without a citation take the one that follows them."""
    out: list[str] = []
    for part in re.split(r"(?<=[。；;])", re.sub(r"[\r\n]+", " ", block).strip()):
        part = part.strip()
        if not part:
            continue
        if _cited(part) and not _bare(part):
            at = range(len(out) - 1, len(out)) if any(_cited(c) for c in out) else range(len(out))
            for i in at:
                out[i] += part
            continue
        out.append(part)
    waiting: list[int] = []
    for i, claim in enumerate(out):
        if not (cited := _cited(claim)):
            waiting.append(i)
            continue
        for k in waiting:
            out[k] += " " + "".join(cited)
        waiting = []
    return out


def claims_of(answer: str) -> list[str]:
    """Claims of an answer's blocks, in order; code, structure and the sections without claims are left out."""
    out: list[str] = []
    section = ""
    for block in re.split(r"\n\s*\n", answer or ""):
        block = block.strip()
        if block.startswith("#"):
            head, _, block = block.partition("\n")
            section, block = head.lstrip("#").strip(), block.strip()
        if not block or any(s in section for s in NO_CLAIMS) or block.startswith("```") or re.fullmatch(r"[-*_=\s|]+", block):
            continue
        lines = [x.strip() for x in block.splitlines()]
        if all(x.startswith("|") for x in lines if x) and any(_cited(x) for x in lines):
            out.extend(" ".join(c.strip() for c in x.strip("|").split("|")) for x in lines if _cited(x))
        elif any(re.match(r"[-*] |\d+\.\s+.", x) for x in lines):
            for x in lines:
                x = re.sub(r"^(?:[-*]\s+|\d+\.\s+)", "", x).strip()
                if x and _bare(x):
                    out.extend(sentences(x))
        else:
            out.extend(sentences(block))
    return [c for c in out if _bare(c)]


def claims(answers: DataFrame, key: str = "answer_id", column: str = "answer") -> DataFrame:
    """key, claim_index, claim of every answer, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, i, c) for k, a in zip(frame[key], frame[column], strict=True) for i, c in enumerate(claims_of(a))], columns=[key, "claim_index", "claim"])

    return answers.select(key, column).mapInPandas(run, f"{key} {answers.schema[key].dataType.simpleString()}, claim_index int, claim string")


def simple_claims(answers: DataFrame, key: str = "answer_id", column: str = "answer") -> DataFrame:
    """key, claim_index, claim for answers of plain sentences, without Python."""
    parts = F.filter(F.transform(F.split(column, r"(?<=[。；;])\s*"), lambda x: F.trim(x)), lambda c: F.length(c) > 0)
    return answers.select(key, F.posexplode(parts).alias("claim_index", "claim"))


def ordinals(claim_rows: DataFrame, key: str = "answer_id", with_claim: bool = False) -> DataFrame:
    """key, claim_index, ordinal, literal, kind, target: every citation with its number within the answer; and its claim, if asked for, which saves a join with the claims."""
    more = ["claim"] if with_claim else []
    rows = claim_rows.select(key, "claim_index", *more, citations(F.col("claim")).alias("c"))
    w = Window.partitionBy(key).orderBy("claim_index").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.withColumn("first", F.coalesce(F.sum(F.size("c")).over(w), F.lit(0)))
    return before.select(key, "claim_index", *more, "first", F.posexplode("c").alias("i", "x")).select(key, "claim_index", *more, (F.col("first") + F.col("i")).alias("ordinal"), "x.*")


def direct_line(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("`"), F.lit("")), r"\[\[[^\]]+\]\]", ""), r"\[→\s*[^\]]+\]", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(bare, r"^\s*[-*]\s*", ""), r"\s+", " ")))


def validate(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds overlap and status to citations (claim, kind, target): NOT_FOUND, SKIPPED, VERIFIED or DEMOTED. evidence: kind, target, text; of several texts of a target the smallest counts."""
    rows = cited.withColumn("_facts", hard_facts(without_citations(F.col("claim")))).join(evidence.groupBy("kind", "target").agg(F.min("text").alias("_text")), ["kind", "target"], "left")
    shared = F.size(F.array_intersect("_facts", evidence_tokens(F.col("_text"))))
    overlap = F.when(F.size("_facts") > 0, shared / F.size("_facts")).otherwise(0.0)
    claim = direct_line(F.col("claim"))
    lines = F.filter(F.transform(F.split("_text", "\r?\n"), direct_line), lambda x: x != "")
    direct = (claim != "") & F.exists(lines, lambda x: F.contains(x, claim) | F.contains(claim, x))
    n = F.size("_facts")
    ok = direct | (overlap >= 1.0) | ((n >= 4) & (overlap >= 0.75)) | ((n >= 2) & (overlap >= 0.66))
    status = F.when(F.col("_text").isNull(), "NOT_FOUND").when(n == 0, "SKIPPED").when(ok, "VERIFIED").otherwise("DEMOTED")
    return rows.withColumn("status", status).withColumn("overlap", F.when(F.col("_text").isNotNull(), F.round(overlap, 9))).drop("_facts", "_text")


def report(claim_rows: DataFrame, checked: DataFrame, key: str = "answer_id") -> DataFrame:
    """Per answer: claims, verified, demoted, skipped, coverage, unsupported."""
    per = checked.groupBy(key, "claim_index").agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("VERIFIED", "DEMOTED", "SKIPPED")))
    rows = claim_rows.select(key, "claim_index").join(per, [key, "claim_index"], "left").na.fill(0)
    sums = rows.groupBy(key).agg(F.count("*").alias("claims"), F.sum("verified").alias("verified"), F.sum("demoted").alias("demoted"), F.sum("skipped").alias("skipped"), F.count_if((F.col("verified") > 0) | (F.col("skipped") > 0)).alias("covered"))
    return sums.select("*", F.round(F.col("covered") / F.col("claims"), 9).alias("coverage"), (F.col("claims") - F.col("covered")).alias("unsupported"))


def claim_status(checked: DataFrame, claim_rows: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, claim_index, claim_status."""
    per = checked.groupBy(key, "claim_index").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "VERIFIED").alias("v"), F.bool_or(F.col("status") == "SKIPPED").alias("s"))
    rows = claim_rows.select(key, "claim_index").join(per, [key, "claim_index"], "left")
    return rows.select(key, "claim_index", F.when(F.col("n").isNull(), "NO_CITATION").when(F.col("v"), "VERIFIED").when(F.col("s"), "PARTIAL").otherwise("UNSUPPORTED").alias("claim_status"))


def nearest_citation(claim_rows: DataFrame, checked: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, claim_index, literal: for each claim without a citation the verified one nearest by claim, the earlier of equals. Two windows, no self-join."""
    usable = checked.where("status = 'VERIFIED'").groupBy(key, "claim_index").agg(F.min_by("literal", "ordinal").alias("own"))
    any_ = checked.select(key, "claim_index").distinct().withColumn("cited", F.lit(True))
    rows = claim_rows.select(key, "claim_index").join(usable, [key, "claim_index"], "left").join(any_, [key, "claim_index"], "left")
    rows = rows.withColumn("at", F.when(F.col("own").isNotNull(), F.struct("claim_index", "own")))
    w = Window.partitionBy(key).orderBy("claim_index")
    rows = rows.withColumn("prev", F.last("at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.first("at", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    back, ahead = F.col("claim_index") - F.col("prev.claim_index"), F.col("next.claim_index") - F.col("claim_index")
    near = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev.own")).otherwise(F.col("next.own"))
    return rows.where("cited IS NULL").select(key, "claim_index", near.alias("literal")).where("literal IS NOT NULL")


def needs_repair(reports: DataFrame, least: float = 0.6, rounds: int = 1, done: int = 0) -> DataFrame:
    """Adds repair to reports (demoted, coverage and, if projections were checked, mismatches), unless ``rounds`` are done."""
    wrong = F.coalesce("mismatches", F.lit(0)) > 0 if "mismatches" in reports.columns else F.lit(False)
    return reports.withColumn("repair", F.lit(done < rounds) & ((F.col("demoted") > 0) | (F.col("coverage") < least) | wrong))


def repair_claims(claim_rows: DataFrame, checked: DataFrame, key: str = "answer_id") -> DataFrame:
    """key, claim_index, claim: claims after one round of repair. checked: key, claim_index, ordinal, literal, status.

    A failed citation goes where the claim keeps a verified one; a claim that has none left, or had none, takes the nearest
    usable citation of its answer or is marked as without evidence.
    """
    usable = F.col("status").isin("VERIFIED", "SKIPPED")
    per = checked.groupBy(key, "claim_index").agg(F.bool_or(F.col("status") == "VERIFIED").alias("_held"), F.collect_set(F.when(F.col("status") == "DEMOTED", F.col("literal"))).alias("_failed"), F.min_by(F.when(usable, F.col("literal")), F.when(usable, F.col("ordinal"))).alias("_own"))
    rows = claim_rows.select(key, "claim_index", "claim").join(per, [key, "claim_index"], "left")
    rows = rows.withColumn("_at", F.when(F.col("_own").isNotNull(), F.struct("claim_index", "_own")))
    w = Window.partitionBy(key).orderBy("claim_index")
    rows = rows.withColumn("_prev", F.last("_at", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_next", F.first("_at", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    back, ahead = F.col("claim_index") - F.col("_prev.claim_index"), F.col("_next.claim_index") - F.col("claim_index")
    near = F.when(F.col("_next").isNull() | (back <= ahead), F.col("_prev._own")).otherwise(F.col("_next._own"))
    bare = F.trim(F.regexp_replace(without_citations(F.col("claim")), f"（{V.NO_EVIDENCE}）", ""))
    marked = F.when(bare == "", F.lit(V.NO_EVIDENCE)).otherwise(F.concat(bare, F.lit(f"（{V.NO_EVIDENCE}）")))
    supported = F.coalesce(F.concat(bare, F.lit(" "), near), marked)
    without = F.aggregate("_failed", F.col("claim"), lambda a, x: F.replace(a, x, F.lit("")))
    cited = F.col("_failed").isNotNull()
    fixed = F.when(cited & F.col("_held"), without).when(cited & (F.size("_failed") == 0), F.col("claim")).when(~cited & F.col("claim").contains(V.NO_EVIDENCE), F.col("claim")).otherwise(supported)
    return rows.select(key, "claim_index", fixed.alias("claim"))


def merge_findings(findings: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """fact_key, value_text, unit, confidence, anchors, claim: one row per fact, the greatest confidence, all anchors in order of the findings. findings: position, fact_key, subject, value_text, unit, claim, confidence, anchors."""
    rows = findings.where(F.col("confidence") >= least)
    ordered = F.array_sort(F.collect_list(F.struct("position", "anchors")))
    merged = F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["anchors"])))
    return rows.groupBy("fact_key", "value_text", "unit").agg(F.max("confidence").alias("confidence"), merged.alias("anchors"), F.min_by("claim", "position").alias("claim"), F.min_by("subject", "position").alias("subject"), F.min("position").alias("position"))


def conflicts(merged: DataFrame) -> DataFrame:
    """fact_key, variants: facts with more than one value and unit."""
    value = F.concat_ws("|", "value_text", "unit")
    return merged.groupBy("fact_key").agg(F.array_sort(F.collect_set(value)).alias("variants")).where(F.size("variants") > 1)


def complements(merged: DataFrame) -> DataFrame:
    """subject, fact_key, other: ordered pairs of facts of one subject (the first finding of each key)."""
    first = merged.groupBy("fact_key").agg(F.min_by("subject", "position").alias("subject"))
    return first.join(first.select("subject", F.col("fact_key").alias("other")), "subject").where("fact_key != other")


def anchor_error(anchor: DataFrame) -> DataFrame:
    """Adds error, null for a valid anchor (anchor_id, source_type, source_id, path, line_start, line_end, quote_text)."""
    article, file = F.col("source_type") == "ARTICLE", F.col("source_type") == "SOURCE_FILE"
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    error = F.when(~F.coalesce("anchor_id", F.lit("")).rlike(r"^ev#\d+$"), "bad_id").when(~F.col("source_type").isin("ARTICLE", "SOURCE_FILE", "GRAPH_FACT", "CONTRIBUTION"), "bad_type").when(blank("source_id"), "no_source")
    error = error.when(file & blank("path"), "no_path").when(file & (F.col("line_end") < F.col("line_start")), "bad_lines").when((article | file) & blank("quote_text"), "no_quote")
    return anchor.withColumn("error", error).withColumn("identity", F.sha2(F.concat_ws("|", "source_type", "source_id", "path", F.col("line_start").cast("string"), F.col("line_end").cast("string"), "quote_text"), 256))


def projection_candidates(merged: DataFrame, anchors: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """fact_key, anchor_id, literal of anchors that an answer may cite."""
    usable = anchors.where(F.col("source_type").isin("ARTICLE", "SOURCE_FILE") & (F.col("retrieval_score") >= least))
    literal = F.when(F.col("source_type") == "ARTICLE", F.concat(F.lit("[["), "source_id", F.lit("]]"))).otherwise(F.concat(F.lit("[→ "), "path", F.lit("]")))
    return merged.select("fact_key", F.explode("anchors").alias("anchor_id")).join(usable.select("anchor_id", literal.alias("literal")), "anchor_id").select("fact_key", "anchor_id", "literal").distinct()


def fact_coverage(required: DataFrame, projections: DataFrame) -> DataFrame:
    """fact_key, covered: whether an active projection (fact_key, status) holds each required fact."""
    got = projections.groupBy("fact_key").agg(F.bool_or(F.col("status") == "ACTIVE").alias("a"))
    return required.select("fact_key").distinct().join(got, "fact_key", "left").select("fact_key", F.coalesce("a", F.lit(False)).alias("covered"))


def white_list(cited: DataFrame, projections: DataFrame) -> DataFrame:
    """Adds status to citations (literal): DEMOTED where no active projection or more than one has it, else VERIFIED."""
    n = projections.where("status = 'ACTIVE'").groupBy("literal").agg(F.count("*").alias("_n"))
    return cited.join(n, "literal", "left").withColumn("status", F.when(F.coalesce("_n", F.lit(0)) == 1, "VERIFIED").otherwise("DEMOTED")).drop("_n")


def repair_projections(projections: DataFrame, changes: DataFrame) -> DataFrame:
    """Projections (answer_id, ordinal, literal, status) after changes (answer_id, ordinal, new_literal; null: removed): what changes is REPLACED, and a row for what stands there now follows."""
    rows = projections.join(changes.withColumn("_hit", F.lit(True)), ["answer_id", "ordinal"], "left")
    hit = F.col("_hit") & (F.col("status") == "ACTIVE")
    old = rows.withColumn("status", F.when(hit, "REPLACED").otherwise(F.col("status"))).select(*projections.columns)
    top = Window.partitionBy("answer_id")
    new = rows.withColumn("_top", F.max("ordinal").over(top)).where(hit)
    w = Window.partitionBy("answer_id").orderBy("ordinal")
    added = new.select("answer_id", (F.col("_top") + F.row_number().over(w)).cast("int").alias("ordinal"), F.coalesce("new_literal", "literal").alias("literal"), F.when(F.col("new_literal").isNull(), "REMOVED").otherwise("ACTIVE").alias("status"))
    return old.unionByName(added)


def project_text(text: Column, literals: Column) -> Column:
    """Evidence ids (``ev#N``) in a text replaced by the literals of a map; unknown ones go."""
    ids = F.array_distinct(T.found(text, r"ev#\d+"))
    order = F.array_sort(F.transform(ids, lambda i: F.struct((-F.length(i)).alias("n"), i.alias("i"))))
    return F.aggregate(order, text, lambda a, s: F.replace(a, s["i"], F.coalesce(F.try_element_at(literals, s["i"]), F.lit(""))))


def confidence(score: Column) -> Column:
    """A finding's confidence from its hit's score."""
    return F.when(score <= 0, 0.2).when(score < 0.55, F.least(F.lit(0.95), score + 0.55)).when(score >= 1, 1.0).otherwise(score)


def findings(hits: DataFrame, most: int = 3) -> DataFrame:
    """task_id, anchor_id, claim, confidence: a finding and its anchor for each of a task's best hits (task_id, key, content, score)."""
    w = Window.partitionBy("task_id").orderBy(F.desc("score"), "key")
    first = hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return first.select("task_id", F.concat(F.lit("ev#"), F.col("n")).alias("anchor_id"), F.lit("claim").alias("predicate"), F.col("task_id").alias("subject"), T.excerpt(F.col("content")).alias("claim"), F.round(confidence(F.col("score")), 9).alias("confidence"))


def answer_sources(hits: DataFrame, most: int = 8) -> DataFrame:
    """The sources that an answer lists: by evidence type, then rank; once per response key and once per first path (without one: per article)."""
    order = F.create_map(*(F.lit(x) for x in ("ARTICLE", 0, "GRAPH", 1, "SOURCE", 2, "CONTRIBUTION", 3)))
    rows = hits.withColumn("_type", order[F.col("evidence_type")])
    first = lambda by: F.row_number().over(Window.partitionBy("question_id", by).orderBy("_type", "rank"))
    rows = rows.withColumn("_key", first("key")).where("_key = 1").withColumn("_id", F.coalesce(F.nullif(T.path_key(F.col("path")), F.lit("")), "key"))
    rows = rows.withColumn("_path", first("_id")).where("_path = 1")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("_type", "rank"))).where(F.col("place") <= most).drop("_type", "_key", "_id", "_path")


def comparison_pick(findings_: DataFrame, dimensions: list[tuple[str, list[str], int]]) -> DataFrame:
    """question_id, dimension, finding_id: the finding with most keyword score for each dimension and one more of equal score; the first finding if none scores. dimensions: name, keywords, score."""
    out = None
    for name, words, score in dimensions:
        s = F.lit(0)
        for w in words:
            s = s + F.when(F.contains(F.lower("claim"), F.lit(w.lower())), score).otherwise(0)
        part = findings_.select("question_id", F.lit(name).alias("dimension"), "finding_id", "position", s.alias("s"))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("question_id", "dimension")
    ranked = out.withColumn("best", F.max("s").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.desc("s"), "position")))
    return ranked.where("(best > 0 AND s = best AND n <= 2) OR (best = 0 AND n = 1)").select("question_id", "dimension", "finding_id")


def multi_hop(expected: DataFrame, found: DataFrame) -> DataFrame:
    """completeness: the share of expected claims (question_id, claim) that the findings (question_id, claim) of their question hold in their text."""
    rows = expected.select("question_id", F.col("claim").alias("wanted")).join(found.groupBy("question_id").agg(F.collect_set(F.lower("claim")).alias("claims")), "question_id", "left")
    hit = F.coalesce(F.exists("claims", lambda c: F.contains(c, F.lower("wanted"))), F.lit(False))
    return rows.agg(F.count("*").alias("expected"), F.count_if(hit).alias("found")).select(F.when(F.col("expected") > 0, F.round(F.col("found") / F.col("expected"), 9)).alias("completeness"))


def graph_fact_rate(accepted: DataFrame) -> DataFrame:
    """accepted_rate: of graph facts (accepted boolean) those that an answer took."""
    return accepted.agg(F.count("*").alias("n"), F.count_if(F.col("accepted")).alias("a")).select(F.when(F.col("n") > 0, F.round(F.col("a") / F.col("n"), 9)).alias("accepted_rate"))


def answer_lines(hits: DataFrame, most: int = 6) -> DataFrame:
    """question_id, place, line, score: the lines of hits (question_id, tokens, content) that answer best: tokens, code marks, assignments and digits add, length beyond 120 takes off; equal texts count once."""
    lines = hits.select("question_id", "tokens", F.explode(F.split("content", "\r?\n")).alias("raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s*(?:[-*]|\d+\.)\s+", "")))
    body = lines.where("line != '' AND NOT line RLIKE '^(#|>|!\\\\[|[|][ :|-]+$)'")
    n = F.size(F.filter("tokens", lambda t: F.contains(F.lower("line"), t)))
    add = lambda cond, x: F.when(cond, float(x)).otherwise(0.0)
    score = n * 10.0 + add(F.contains("line", F.lit("`")), 6) + add(F.contains("line", F.lit(" = ")), 12) + add(F.col("line").rlike("[0-9]"), 3) - F.greatest(F.lit(0.0), (F.length("line") - 120) / 24)
    best = body.where(n > 0).select("question_id", "line", F.round(score, 6).alias("score")).groupBy("question_id", "line").agg(F.max("score").alias("score"))
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.length("line"), "line")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def retrieval_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """recall_5, recall_10, mrr over questions with an expected key (ratio of sums; null without any). ranked: question_id, key, rank."""
    rows = expected.join(ranked, ["question_id", "key"], "left")
    per = rows.groupBy("question_id").agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 5).alias("at5"), F.count_if(F.col("rank") <= 10).alias("at10"), F.min("rank").alias("first"))
    total = per.agg(*(F.sum(c).alias(c) for c in ("n", "at5", "at10")), F.sum(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"), F.count("*").alias("questions"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 9))
    return total.select(ratio("at5", "n").alias("recall_5"), ratio("at10", "n").alias("recall_10"), ratio("rr", "questions").alias("mrr"))


def answer_metrics(reports: DataFrame, checked: DataFrame) -> DataFrame:
    """unsupported_rate, precision, coverage over all answers: ratios of sums, null where nothing counts."""
    a = reports.agg(F.sum("claims").alias("claims"), F.sum("unsupported").alias("unsupported"), F.sum("covered").alias("covered"))
    b = checked.agg(F.count_if(F.col("status").isin("VERIFIED", "DEMOTED", "NOT_FOUND")).alias("judged"), F.count_if(F.col("status") == "VERIFIED").alias("verified"))
    ratio = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) / F.col(y), 9))
    return a.crossJoin(b).select(ratio("unsupported", "claims").alias("unsupported_rate"), ratio("verified", "judged").alias("precision"), ratio("covered", "claims").alias("coverage"))
