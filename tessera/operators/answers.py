"""Answers put together from the lines of hits: question types score lines, and picks cover the parts of a question.

A question can be of several types (a fact, a number, a status, a capability, a flow, a list, a setup); each type adds to
lines that look like its answers and takes from lines that don't. Of a question that asks for facts in several parts, each
part first gets the best line that names it and wasn't taken for an earlier part (a greedy cover); then the best lines
follow. Sources of an answer are its active projections, else its hits by type and priority.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V


def low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def points(when: Column, n: int) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)


def count_of(c: Column, *parts: str) -> Column:
    """How often any of the parts stands in c."""
    return reduce(lambda a, b: a + b, ((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p) for p in parts))


def question_types(question: Column) -> Column:
    """A struct of booleans: fact, number, setup, capability, listing, flow, status, current, configuration."""
    q = low(question)
    has = {name: T.any_of(q, words) for name, words in V.QUESTION_TYPES.items()}
    starting = F.contains(q, F.lit("启动前")) | (F.contains(q, F.lit("启动")) & (F.contains(q, F.lit("之前")) | F.contains(q, F.lit("先"))))
    status = has["status"] | (~has["listing"] & ~has["fact"] & has["current"])
    configuration = F.contains(q, F.lit("配置"))
    return F.struct(*(has[n].alias(n) for n in ("fact", "number", "capability", "listing", "flow", "current")), (starting & has["setup"]).alias("setup"), status.alias("status"), configuration.alias("configuration"))


def is_key(c: Column) -> Column:
    """Whether a text looks like the name of a setting."""
    return T.any_of(low(c), V.KEY_PARTS)


def key_of(line: Column) -> Column:
    """What stands before the first `` = `` of a line; null without one."""
    at = F.instr(line, " = ")
    return F.when(at > 1, F.trim(F.substring(line, F.lit(1), at - 1)))


def echo(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(low(c), V.ECHO_SIGNS, ""), r"\d+$", "")


def base_score(raw: Column, line: Column, tokens: Column) -> Column:
    """What a line is worth for any question."""
    text = low(line)
    score = F.size(F.filter(tokens, lambda t: F.contains(text, F.lower(t)))) * 10 + points(F.contains(line, F.lit("`")), 6)
    score += points(F.contains(line, F.lit(" = ")), 12) + points(is_key(key_of(line)), 10) + points(line.rlike(r"\d"), 3)
    for words, n in V.LINE_WORDS:
        score += points(T.any_of(text, words), n)
    fields = reduce(lambda a, b: a | b, (F.startswith(low(raw), F.lit(f)) for f in V.TEXT_FIELDS))
    return score - points(fields, 2) - F.greatest(F.lit(0), F.floor((F.length(line) - 120) / 24)).cast("int")


def line_score(question: Column, raw: Column, line: Column, tokens: Column) -> Column:
    """What a line is worth as an answer to the question."""
    q, text, k, t = low(question), low(line), key_of(line), question_types(question)
    assigned = F.coalesce(k.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))
    lead_in = line.rlike("[:：]$") & ~F.contains(line, F.lit("->")) & ~line.rlike(r"\d") & ~F.contains(line, F.lit("`"))
    bullet = F.trim(raw).rlike(r"^(?:\||[-*•] |\d+\.\s+)")
    listed = bullet | assigned | (count_of(line, "；") >= 2) | (count_of(line, "、") >= 2) | (F.contains(line, F.lit("：")) & ~lead_in)
    can = T.any_of(text, V.CAPABILITY_SIGNALS) | (count_of(line, "、", " / ", "·") >= 2) | (count_of(line, "`") >= 4)
    flows = T.any_of(text, V.FLOW_SIGNALS)
    heading = low(F.trim(raw)).rlike("^(?:#|<h[1-4])")
    mine, theirs = echo(question), echo(line)
    echoed = (F.length(mine) >= 6) & (F.length(theirs) >= 6) & (F.contains(mine, theirs) | F.contains(theirs, mine))
    rules = [
        (is_fact(question, line), 12),
        (echoed, -60),
        (is_contents(line), -80),
        (t["listing"] & listed, 32),
        (t["flow"] & T.any_of(text, V.STEP_SIGNS), 18),
        (assigned, 8),
        (t["number"] & line.rlike(r"\d"), 6),
        (T.any_of(q, V.QUESTION_TYPES["current"]) & T.any_of(text, V.CURRENT_SIGNS), 4),
        (t["setup"] & (line.rlike(r"^\d+\.\s+") | T.any_of(text, V.SETUP_SIGNS)), 24),
        (t["capability"] & can, 50),
        (t["flow"] & flows, 24),
        (t["status"] & T.any_of(text, V.STATUS_SIGNS), 24),
        (t["status"] & heading, -8),
        (t["flow"] & heading, -8),
        (t["listing"] & heading, -18),
        (t["flow"] & lead_in & ~flows, -10),
        (t["listing"] & lead_in & ~listed, -14),
        (t["capability"] & line.rlike(V.SUMMARY_SENTENCES), -18),
        (t["capability"] & assigned, -50),
        (t["setup"] & assigned, -28),
        (t["configuration"] & (F.startswith(text, F.lit("代码中的")) | F.contains(text, F.lit("数值一致"))), -8),
    ]
    return reduce(lambda a, b: a + b, (points(when, n) for when, n in rules), base_score(raw, line, tokens))


def is_fact(question: Column, line: Column) -> Column:
    """An assignment to a setting, or, if facts are asked for, a line that names a setting and holds a digit."""
    return F.when(key_of(line).isNotNull(), is_key(key_of(line))).otherwise(question_types(question)["fact"] & is_key(line) & line.rlike(r"\d"))


def is_contents(line: Column) -> Column:
    """A line of a table of contents, or the mark of a page."""
    return (line == "目录") | F.startswith(low(line), F.lit("=== page:")) | ((F.length(line) <= 120) & line.rlike(r"(?s)^(?:.*[？?].*\s+\d+|.*\t\d+)$"))


def focus_parts(question: Column) -> Column:
    """The parts of a question that asks for several facts, in order: what stands between its separators, cleaned; without any, its two best tokens."""
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), V.FOCUS_FILLERS, F.lower(s)), V.FOCUS_SIGNS, " "), r"\s+", " "))
    good = lambda parts: F.filter(F.transform(parts, clean), lambda p: (p != "") & (is_key(p) | (F.length(p) >= 2)))
    parts = good(F.split(F.coalesce(question, F.lit("")), V.FOCUS_SEPARATORS))
    return F.when(F.size(parts) > 0, parts).otherwise(F.slice(good(T.high_signal(F.coalesce(question, F.lit("")))), 1, 2))


def candidate_lines(hits: DataFrame, matched: int = 6) -> DataFrame:
    """question_id, question, line, score, fact, status, place of the lines of hits (question_id, question, tokens, content, rank) that can be answers: all where the question's type asks for that, else the first ``matched`` of each hit that hold a token. Texts are filtered as arrays before anything is exploded."""
    types = question_types(F.col("question"))
    body = F.transform(F.split(F.coalesce("content", F.lit("")), "\r\n|\r|\n"), lambda line, i: F.struct(F.trim(line).alias("raw"), i.alias("i")))
    text = lambda s: F.regexp_replace(s, "^- ", "")
    readable = lambda s: (s["raw"] != "") & (s["raw"] != "---") & ~s["raw"].rlike(r"^(?:[#>]|!\[|\|[ :|-]+\|?$)") & ~low(s["raw"]).rlike(V.FIELD_LINES) & ~is_contents(s["raw"])
    any_token = lambda s: F.exists("tokens", lambda t: F.contains(low(s["raw"]), F.lower(t)))
    asks = types["fact"] | types["status"] | types["capability"] | types["flow"] | types["listing"]
    rows = hits.withColumn("_body", F.filter(body, readable))
    rows = rows.withColumn("_lines", F.when(asks, F.col("_body")).otherwise(F.slice(F.filter("_body", any_token), 1, matched)))
    rows = rows.select("question_id", "question", "tokens", "rank", F.explode("_lines").alias("s"))
    rows = rows.select("question_id", "question", "tokens", F.col("s.raw").alias("raw"), F.trim(text(F.col("s.raw"))).alias("line"), F.struct("rank", "s.i").alias("place")).where("line != ''")
    fact, status = is_fact(F.col("question"), F.col("line")), T.any_of(low(F.col("line")), V.STATUS_SIGNS) & question_types(F.col("question"))["status"]
    scored = rows.select("question_id", "question", "line", line_score(F.col("question"), F.col("raw"), F.col("line"), F.col("tokens")).alias("score"), fact.alias("fact"), status.alias("status"), "place")
    # one line counts once, with its best score
    return scored.groupBy("question_id", "question", "line").agg(F.max("score").alias("score"), F.bool_or("fact").alias("fact"), F.bool_or("status").alias("status"), F.min("place").alias("place"))


def focused_answer(hits: DataFrame, limit: int = 3) -> DataFrame:
    """question_id, place, line, part (the part of the question that it was picked for, or null) of the ``limit`` lines that answer each question.

    Of status lines, fact lines and all lines the first kind that the question asks for and has is taken. For each part of
    a question only the ``limit`` best lines that name it can be picked, so that is all that is gathered.
    """
    lines, kind = candidate_lines(hits), question_types(F.col("question"))
    lines = lines.withColumn("_none", (F.length(echo(F.col("question"))) >= 6) & (F.length(echo(F.col("line"))) >= 6) & (F.contains(echo(F.col("question")), echo(F.col("line"))) | F.contains(echo(F.col("line")), echo(F.col("question")))))
    lines = lines.where(~F.col("_none")).drop("_none")
    w = Window.partitionBy("question_id")
    has = lines.withColumn("_status", F.max(F.col("status").cast("int")).over(w) == 1).withColumn("_fact", F.max(F.col("fact").cast("int")).over(w) == 1)
    listing = kind["listing"] & ~kind["fact"]
    kept = has.where(F.when(kind["status"] & F.col("_status"), F.col("status")).when(listing, F.lit(True)).when(F.col("_fact"), F.col("fact")).otherwise(True))
    order = [F.desc("score"), F.length("line"), "place", "line"]
    kept = kept.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    several = (F.lit(limit) > 1) & kind["fact"]
    kept = kept.withColumn("_parts", F.when(several, focus_parts(F.col("question"))).otherwise(F.array().cast("array<string>")))
    named = kept.select("question_id", "_n", "line", F.posexplode("_parts").alias("_p", "_part")).where(F.contains(low(F.col("line")), F.col("_part")))
    named = named.withColumn("_m", F.row_number().over(Window.partitionBy("question_id", "_p").orderBy("_n"))).where(F.col("_m") <= limit)
    per = named.groupBy("question_id", "_p", "_part").agg(F.array_sort(F.collect_list("_n")).alias("ns"))
    parts = per.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("_p", "_part", "ns"))).alias("parts"))
    # the cover: for each part in its order the best line that isn't taken; ``limit`` at most
    taken = F.aggregate(
        "parts",
        F.array().cast("array<struct<n:int,part:string>>"),
        lambda got, p: F.when(
            (F.size(got) < limit) & F.exists(p["ns"], lambda n: ~F.exists(got, lambda g: g["n"] == n)),
            F.array_append(got, F.struct(F.element_at(F.filter(p["ns"], lambda n: ~F.exists(got, lambda g: g["n"] == n)), 1).alias("n"), p["_part"].alias("part"))),
        ).otherwise(got),
    )
    cover = parts.select("question_id", F.posexplode(taken).alias("_at", "pick")).select("question_id", F.col("pick.n").alias("_n"), "_at", F.col("pick.part").alias("part"))
    few = kept.where((F.col("_n") <= 2 * limit) | (F.size("_parts") > 0)).select("question_id", "_n", "line", "score")
    rows = few.join(cover, ["question_id", "_n"], "left")
    place = F.row_number().over(w.orderBy(F.col("_at").isNull(), "_at", "_n"))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select("question_id", "place", "line", "score", "part")


def response_sources(hits: DataFrame, projections: DataFrame, most: int = 8) -> DataFrame:
    """question_id, key, place, origin of the sources that an answer lists: its active projections (question_id, key, status, ordinal), each key once and in their order, else the hits (question_id, evidence_type, key, concept_id, title, path, rank) by type, then by rank. Of hits with one key, that with the highest index priority stands for it: articles first, then those with a concept, a path, a title."""
    active = projections.where("status = 'ACTIVE'").groupBy("question_id", "key").agg(F.min("ordinal").alias("ordinal"))
    shown = active.select("question_id", "key", F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal", "key")).alias("place"), F.lit("PROJECTION").alias("origin"))
    filled = lambda c, n: points(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", n)
    priority = points(F.col("evidence_type") == "ARTICLE", 100) + filled("key", 30) + filled("concept_id", 20) + filled("path", 10) + filled("title", 5)
    order = F.create_map(*(F.lit(x) for x in ("ARTICLE", 0, "GRAPH", 1, "SOURCE", 2, "CONTRIBUTION", 3)))[F.col("evidence_type")]
    rows = hits.join(active.select("question_id").distinct(), "question_id", "left_anti").withColumn("_type", order).withColumn("_priority", priority)
    first = lambda by: F.row_number().over(Window.partitionBy("question_id", by).orderBy(F.desc("_priority"), "_type", "rank"))
    rows = rows.withColumn("_k", first("key")).where("_k = 1")
    rows = rows.withColumn("_id", F.coalesce(F.nullif(T.path_key(F.col("path")), F.lit("")), "key")).withColumn("_s", first("_id")).where("_s = 1")
    ranked = rows.select("question_id", "key", F.row_number().over(Window.partitionBy("question_id").orderBy("_type", "rank", "key")).alias("place"), F.lit("HIT").alias("origin"))
    return shown.unionByName(ranked).where(F.col("place") <= most)
