"""Lexical and vector retrieval, fusion, reranking, relevance and audit over whole question sets.

Every channel returns ``HIT`` rows: question_id, channel, evidence_type, key, concept_id, title, content, path, score.
Questions are a stated set (read once, broadcast only behind a row check by the planner); documents are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from . import fulltext
from .common import cut

try:
    import ahocorasick
except ImportError:  # then every token is looked for in turn
    ahocorasick = None

#: (question, token) rows that are broadcast at a time; more questions take more passes over the documents.
MOST_TOKENS = 200_000
HIT = ["question_id", "channel", "evidence_type", "key", "concept_id", "title", "content", "path", "score"]


def question_tokens(questions: DataFrame) -> DataFrame:
    """question_id, token: all tokens of each question."""
    return questions.select("question_id", F.explode(T.tokens(F.col("question"))).alias("token"))


def token_blocks(tokens: DataFrame) -> Iterator[list[tuple]]:
    """The (question_id, token) rows in blocks of some ``MOST_TOKENS``, whole questions each."""
    n = tokens.count()
    blocks = -(-2 * n // MOST_TOKENS) if n > MOST_TOKENS else 1
    for b in range(blocks):
        mine = tokens if blocks == 1 else tokens.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b)
        yield [(r.question_id, r.token) for r in mine.collect()]  # a block at a time


def finder(tokens: list[str]):
    """A function that gives the numbers of the tokens that a text holds."""
    if not ahocorasick:
        return lambda text: {i for i, t in enumerate(tokens) if t in text}
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(tokens):
        automaton.add_word(t, i)
    automaton.make_automaton()
    return lambda text: {i for _, i in automaton.iter(text)} if tokens else set()


def like_top(questions: DataFrame, docs: DataFrame, id_column: str, channels: dict[str, dict[str, float]], k: int) -> DataFrame:
    """question_id, channel, id, score, rank: for each channel the k best documents of each question; a document scores the
    weights of the channel's columns that hold a token, summed over the question's tokens.

    Substring matching has no key to join on. The tokens of a block of questions become one automaton that is broadcast; each
    task reads each text once for all channels and questions and keeps its k best of each, so that what is shuffled is bounded
    by the questions. Ties go to the smaller id.
    """
    tokens = question_tokens(questions)
    columns = list(dict.fromkeys(c for weights in channels.values() for c in weights))
    rows = docs.select(F.col(id_column).alias("id"), *(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_{c}") for c in columns))
    kind, asked = rows.schema["id"].dataType.simpleString(), tokens.schema["question_id"].dataType.simpleString()
    out = None
    for block in token_blocks(tokens):
        part = rows.mapInPandas(_best_of_task(spark_broadcast(rows, block), columns, channels, k), f"question_id {asked}, channel string, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("question_id", "channel").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spark_broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def _best_of_task(held, columns: list[str], channels: dict[str, dict[str, float]], k: int):
    """The tokens that the texts of a block hold become counts for each text and question at once; a question's k-th score so far drops rows before they are sorted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, ids = list(dict.fromkeys(t for _, t in held.value)), list(dict.fromkeys(q for q, _ in held.value))
        number, place = {t: i for i, t in enumerate(names)}, {q: i for i, q in enumerate(ids)}
        pairs = np.array(sorted((number[t], place[q]) for q, t in held.value), np.int64).reshape(-1, 2)
        first, askers = np.searchsorted(pairs[:, 0], np.arange(len(names) + 1)), pairs[:, 1]
        find = finder(names)

        def counted(texts: list[str]) -> np.ndarray:
            """How many tokens of each question each text holds."""
            found = [np.fromiter(x, np.int64, len(x)) for x in map(find, texts)]
            token, row = np.concatenate([*found, np.zeros(0, np.int64)]), np.repeat(np.arange(len(texts)), [len(x) for x in found])
            n = first[token + 1] - first[token]
            at = np.repeat(first[token] - np.cumsum(n) + n, n) + np.arange(n.sum())
            return np.bincount(np.repeat(row, n) * len(ids) + askers[at], minlength=len(texts) * len(ids)).reshape(len(texts), len(ids))

        best: dict[str, pd.DataFrame] = {}
        least = {c: np.zeros(len(ids)) for c in channels}
        for frame in frames:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                sums = {c: np.zeros((len(part), len(ids))) for c in channels}
                for j, c in enumerate(columns, 1):
                    held_by = counted(part.iloc[:, j].tolist())
                    for channel, weights in channels.items():
                        if c in weights:
                            sums[channel] += weights[c] * held_by
                for channel, total in sums.items():
                    i, q = np.nonzero((total > 0) & (total >= least[channel]))
                    new = pd.DataFrame({"q": q, "id": part["id"].to_numpy()[i], "score": total[i, q]})
                    both = pd.concat([best[channel], new]) if channel in best else new
                    both = both.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
                    best[channel] = both = both[both.groupby("q").cumcount() < k]
                    full = both.groupby("q")["score"].agg(["size", "min"])
                    full = full[full["size"] == k]
                    least[channel][full.index.to_numpy(np.int64)] = full["min"].to_numpy()
        for channel, rows in best.items():
            yield pd.DataFrame({"question_id": [ids[q] for q in rows["q"]], "channel": channel, "id": rows["id"].to_numpy(), "score": rows["score"].to_numpy()})

    return run


def first_holders(rows: DataFrame, tokens: DataFrame, columns: list[str], order: str, most: int) -> DataFrame:
    """question_id, id, order: of the rows (id, lower-case columns, order) of which a column holds a token of the question, the first ``most`` of each question by order and id.

    The first rows of a question are among the first of each of its tokens, so the different tokens are looked for, in blocks
    of ``MOST_TOKENS``, and never the questions: each task reads its texts once and keeps the first ones of each token.
    """

    def found(held):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find, best = finder(held.value), None
            for frame in frames:
                part = frame.sort_values(["order", "id"], kind="stable")
                holds = [set().union(*map(find, texts)) for texts in zip(*(part[c] for c in columns), strict=True)]
                n = np.fromiter(map(len, holds), np.int64, len(holds))
                i = np.repeat(np.arange(len(part)), n)
                new = pd.DataFrame({"t": np.fromiter((t for x in holds for t in x), np.int64, n.sum()), "id": part["id"].to_numpy()[i], "order": part["order"].to_numpy()[i]})
                new = new[new.groupby("t").cumcount() < most]
                best = new if best is None else pd.concat([best, new]).sort_values(["t", "order", "id"], kind="stable")
                best = best[best.groupby("t").cumcount() < most]
            if best is not None:
                text = lambda values: pd.Series(list(values), dtype="object")  # noqa: E731  none at all has a type, too
                yield pd.DataFrame({"token": text(held.value[t] for t in best["t"]), "id": best["id"].to_numpy(), "order": text(best["order"])})

        return run

    kind, out = rows.schema["id"].dataType.simpleString(), None
    rows, words = rows.select("id", *columns, F.col(order).alias("order")), tokens.select("token").distinct()
    n = words.count()
    blocks = -(-2 * n // MOST_TOKENS) if n > MOST_TOKENS else 1
    for b in range(blocks):
        mine = words if blocks == 1 else words.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b)
        held = spark_broadcast(rows, [r.token for r in mine.collect()])  # a block at a time
        part = rows.mapInPandas(found(held), f"token string, id {kind}, order string")
        out = part if out is None else out.unionByName(part)
    first = F.slice(F.array_sort(F.collect_list(F.struct("order", "id"))), 1, most)
    few = cut(out.withColumn("n", F.row_number().over(Window.partitionBy("token").orderBy("order", "id"))).where(F.col("n") <= most).groupBy("token").agg(first.alias("few")))
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("few")))), 1, most)
    return tokens.join(few, "token").groupBy("question_id").agg(F.explode(merged).alias("f")).select("question_id", "f.id", "f.order")


def holders(rows: DataFrame, tokens: DataFrame, columns: list[str]) -> DataFrame:
    """question_id, id: every pair of a row (id, columns) and a question of which a column holds a token (question_id, token). One pass of an automaton; for tokens that few rows hold, such as whole names."""

    def found(held):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            askers: dict[str, list] = {}
            for q, t in held.value:
                askers.setdefault(t, []).append(q)
            names = list(askers)
            find = finder(names)
            for frame in frames:
                out = {(q, row[0]) for row in frame.itertuples(index=False) for text in row[1:] for t in find(text or "") for q in askers[names[t]]}
                yield pd.DataFrame({"question_id": pd.Series([q for q, _ in out], dtype="object"), "id": pd.Series([i for _, i in out], dtype=frame["id"].dtype)})

        return run

    kind, asked, out = rows.schema["id"].dataType.simpleString(), tokens.schema["question_id"].dataType.simpleString(), None
    for block in token_blocks(tokens):
        part = rows.select("id", *columns).mapInPandas(found(spark_broadcast(rows, block)), f"question_id {asked}, id {kind}")
        out = part if out is None else out.unionByName(part)
    return out


def top_k(scores: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best per question with their rank."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fts_match(questions: DataFrame, docs: DataFrame, id_column: str, column: str) -> DataFrame:
    """question_id, id, score: documents that hold all of a question's different words, by cover density (see ``fulltext``), without an index: the texts are read once and nothing is shuffled."""
    return fulltext.matches(questions, docs, id_column, column)


def rewrite(questions: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rewritten`` and ``applied``: rules (pattern, appended text) in their order; later rules see what earlier ones appended."""
    text, applied = F.col("question"), F.array().cast("array<string>")
    for pattern, added in rules:
        fires = F.contains(F.lower(text), F.lit(pattern.lower())) & ~F.contains(text, F.lit(added))
        applied = F.when(fires, F.array_append(applied, F.lit(pattern))).otherwise(applied)
        text = F.when(fires, F.concat(text, F.lit(" " + added))).otherwise(text)
    return questions.withColumn("applied", applied).withColumn("rewritten", text)


def channel_weights(questions: DataFrame) -> DataFrame:
    """question_id, intent, channel, weight: base, times the intent's boost, times the semantic boost; vector channels off for code and configuration or without a signal."""
    q = questions.select("question_id", T.intent(F.col("question")).alias("intent"), (F.size(T.high_signal(F.col("question"))) > 0).alias("signal"))
    base = F.create_map(*(x for c, w in V.CHANNELS.items() for x in (F.lit(c), F.lit(w))))
    rows = q.select("*", F.explode(base).alias("channel", "base"))
    boost = F.lit(1.0)
    for name, channels in V.INTENT_BOOST.items():
        for c, w in channels.items():
            boost = F.when((F.col("intent") == name) & (F.col("channel") == c), w).otherwise(boost)
    semantic = F.lit(1.0)
    for c, w in V.SEMANTIC_BOOST.items():
        semantic = F.when((F.col("channel") == c) & F.col("signal") & F.col("intent").isin("GENERAL", "ARCHITECTURE"), w).otherwise(semantic)
    off = F.col("channel").isin("article_vector", "chunk_vector") & (F.col("intent").isin("CODE_STRUCTURE", "CONFIGURATION") | ~F.col("signal"))
    return rows.select("question_id", "intent", "channel", F.when(off, 0.0).otherwise(F.col("base") * boost * semantic).alias("weight"))


def strategy_tags(weights: DataFrame, rewritten: DataFrame, parallel: bool = True) -> DataFrame:
    """question_id, tag: the strategy of each question in one string. weights: as of ``channel_weights``; rewritten: question_id, applied."""
    on = lambda c: F.when(c, "on").otherwise("off")
    any_on = lambda *names: F.bool_or(F.col("channel").isin(*names) & (F.col("weight") > 0))
    per = weights.groupBy("question_id", "intent").agg(any_on("graph").alias("graph"), any_on("article_vector", "chunk_vector").alias("vector"))
    rows = per.join(rewritten.select("question_id", (F.size("applied") > 0).alias("rewrite")), "question_id")
    tag = F.concat(F.lit("intent="), "intent", F.lit("|mode=" + ("parallel" if parallel else "serial") + "|rewrite="), on(F.col("rewrite")), F.lit("|graph="), on(F.col("graph")), F.lit("|vector="), on(F.col("vector")))
    return rows.select("question_id", tag.alias("tag"))


def fuse(hits: DataFrame, weights: DataFrame, k: int = V.RRF_K, limit: int = 5, places: int = 12) -> DataFrame:
    """Weighted reciprocal rank fusion of hits (question_id, channel, evidence_type, key, rank): each hit adds weight / (k + rank); every hit counts, duplicates too."""
    parts = hits.join(weights.select("question_id", "channel", "weight"), ["question_id", "channel"]).where("weight > 0")
    scores = parts.groupBy("question_id", "evidence_type", "key").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), places).alias("score"))
    return top_k(scores, limit, "key", "evidence_type")


def audit(hits: DataFrame, fused: DataFrame) -> DataFrame:
    """Every channel hit with its fused rank, null where fusion left it out."""
    ranks = fused.select("question_id", "key", F.col("rank").alias("fused_rank")).groupBy("question_id", "key").agg(F.min("fused_rank").alias("fused_rank"))
    return hits.join(ranks, ["question_id", "key"], "left")


def intent_bonus(question: Column, intent: Column, key: Column, concept: Column, title: Column, content: Column, paths: Column) -> Column:
    """What an intent adds to a hit's score."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    path_any = lambda test: F.exists(paths, lambda p: test(F.lower(p)))
    candidate = F.exists(T.config_candidates(question), lambda c: F.contains(low(key), c) | F.contains(low(concept), c) | F.contains(low(title), c) | F.contains(low(content), c) | F.exists(paths, lambda p: F.contains(F.lower(p), c)))
    image = (F.size(paths) > 0) & F.forall(paths, lambda p: T.ends_with_any(F.lower(p), V.IMAGE_ENDINGS))
    meta = T.any_of(F.concat_ws(" ", low(key), low(concept), low(title), F.lower(F.array_join(paths, " "))), V.META_PARTS)
    n = lambda cond, x: F.when(cond, float(x)).otherwise(0.0)
    configuration = n(candidate, 18) + n(path_any(lambda p: T.ends_with_any(p, V.CONFIG_ENDINGS)), 6) + n(image, -18) + n(meta, -10)
    architecture = n(path_any(lambda p: T.any_of(p, V.ARCHITECTURE_PARTS)), 12) + n(image, -14) + n(meta, -8)
    built = T.any_of(F.lower(question), V.INTENTS["ARCHITECTURE"])
    return F.when(intent == "CONFIGURATION", configuration).when((intent == "ARCHITECTURE") | built, architecture).otherwise(0.0)


def relevance(hits: DataFrame) -> DataFrame:
    """Adds relevance_score and relevant to hits (question, key, concept_id, title, description, content, paths).

    A hit is relevant by its score and the tokens that it holds; a question about a flow or about capabilities also accepts
    evidence that shows one; a question about upkeep accepts nothing without one of its anchors.
    """
    q = F.lower(F.coalesce("question", F.lit("")))
    rows = hits.withColumn("_signal", T.high_signal(F.col("question")))
    has = lambda c, t: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), t)
    structured = lambda t: has("key", t) | has("concept_id", t) | has("title", t) | has("description", t) | F.exists("paths", lambda p: F.contains(F.lower(p), t))
    titled = lambda t: has("title", t) | has("description", t)
    anywhere = lambda t: structured(t) | has("content", t)
    part = lambda t: F.when(structured(t), T.token_weight(t) + 6).when(titled(t), T.token_weight(t) + 4).when(has("content", t), T.token_weight(t) + 2).otherwise(0)
    rows = rows.withColumn("relevance_score", F.aggregate("_signal", F.lit(0), lambda a, t: a + part(t)))
    entities = F.filter("_signal", T.is_entity)
    strong = F.size(F.filter("_signal", lambda t: T.is_strong(t) & anywhere(t)))
    general = (F.col("relevance_score") > 0) & F.when(F.size(entities) > 0, F.exists(entities, structured) | (F.col("relevance_score") >= 8)).otherwise((strong >= 1) | (F.col("relevance_score") >= 5))

    def in_any_field(test) -> Column:
        fields = reduce(lambda a, b: a | b, (test(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "content", "description")))
        return fields | F.exists("paths", test)

    flows = lambda x: F.contains(x, F.lit("->")) | T.any_of(F.lower(x), V.FLOW_SIGNALS)
    count = lambda x, parts: reduce(lambda a, b: a + b, (T.occurrences(x, p) for p in parts))
    capable = lambda x: T.any_of(F.lower(x), V.CAPABILITY_SIGNALS) | (count(x, V.LIST_SEPARATORS) >= 2) | (count(x, ["`"]) >= 4)
    flow = T.any_of(q, V.FLOW_QUESTIONS) & in_any_field(flows) & ((F.size(entities) == 0) | F.exists(entities, anywhere))
    capability = T.any_of(q, V.CAPABILITY_QUESTIONS) & F.exists("_signal", lambda t: T.any_of(t, V.CAPABILITY_TOPICS)) & in_any_field(capable)
    anchors = F.filter("_signal", lambda t: T.any_of(t, V.UPKEEP_TOKENS))
    strayed = T.any_of(q, V.UPKEEP_ANCHORS) & T.any_of(q, V.UPKEEP_ACTIONS) & (F.size(anchors) > 0) & ~F.exists(anchors, anywhere)
    return rows.withColumn("relevant", ~strayed & (flow | capability | general)).drop("_signal")


def rerank(hits: DataFrame) -> DataFrame:
    """Hits (question_id, question, channel, key, concept_id, title, description, content, paths, score) with the intent's bonus in their score, ranked anew in their channel: by score, then relevance, then title."""
    bonus = intent_bonus(F.col("question"), T.intent(F.col("question")), F.col("key"), F.col("concept_id"), F.col("title"), F.col("content"), F.col("paths"))
    rows = relevance(hits).withColumn("score", F.col("score") + bonus)
    w = Window.partitionBy("question_id", "channel").orderBy(F.desc("score"), F.desc("relevance_score"), F.lower(F.coalesce("title", F.lit(""))), "key")
    return rows.withColumn("rank", F.row_number().over(w))


def search(questions: DataFrame, channels: dict, rules: list[tuple[str, str]] = (), limit: int = 5, k: int = V.RRF_K) -> tuple[DataFrame, DataFrame]:
    """The fused hits (question_id, evidence_type, key, score, rank, relevant) and the audit of all channels' hits.

    Questions are rewritten by rules; each channel is a function from the rewritten questions (question_id, question) to hits
    (question_id, evidence_type, key, concept_id, title, description, content, paths, score), of which the ``limit`` best of a
    question are taken where the question's strategy gives the channel weight, reranked and fused. Of fused hits those that
    aren't relevant go, unless none is.
    """
    limit = T.clamp(limit, 5, 100)
    asked = rewrite(questions, list(rules)).select("question_id", F.col("rewritten").alias("question"))
    weights = channel_weights(asked)
    found = None
    for name, channel in channels.items():
        if channel is None:  # a channel that the deployment lacks has no hits
            continue
        w = Window.partitionBy("question_id").orderBy(F.desc("score"), "key")
        part = channel(asked).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n").withColumn("channel", F.lit(name))
        found = part if found is None else found.unionByName(part)
    open_ = found.join(weights.where("weight > 0").select("question_id", "channel"), ["question_id", "channel"]).join(asked, "question_id")
    # a few rows for each question and channel: written once, so that no channel runs again and each plan stays short
    ranked = cut(rerank(cut(open_)))
    fused = fuse(ranked, weights, k, limit)
    judged = ranked.groupBy("question_id", "evidence_type", "key").agg(F.bool_or("relevant").alias("relevant"))
    best = keep_relevant(fused.join(judged, ["question_id", "evidence_type", "key"]))
    return best, audit(ranked.select("question_id", "channel", "evidence_type", "key", "rank", "score"), fused)


def research_hits(hits: DataFrame) -> DataFrame:
    """The hits (of tasks as questions, with evidence_type and ``relevant``) that a research task keeps: the relevant ones, of these those that name an entity of the question in key, concept, title or path if any does, and all graph hits."""
    named = F.filter(T.high_signal(F.col("question")), lambda t: F.contains(t, F.lit("_")) | F.contains(t, F.lit("-")) | F.contains(t, F.lit("/")) | T.is_ascii(t))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    holds = lambda t: F.contains(low("key"), t) | F.contains(low("concept_id"), t) | F.contains(low("title"), t) | F.exists("paths", lambda p: F.contains(F.lower(p), t))
    rows = hits.withColumn("_named", F.col("relevant") & F.exists(named, holds))
    some = F.max(F.col("_named").cast("int")).over(Window.partitionBy("question_id"))
    rows = rows.withColumn("_some", some)
    return rows.where((F.col("evidence_type") == "GRAPH") | (F.col("relevant") & (F.col("_named") | (F.col("_some") == 0)))).drop("_named", "_some")


def lexical(questions: DataFrame, docs: DataFrame, id_column: str, weights: dict[str, float], k: int, fts: str | dict[str, float] | None = None) -> DataFrame:
    """question_id, id, score: the k best rows that hold any token or, in a column of ``fts`` (a column, or columns with the weights of their ranks), all words of a question; the weights of the columns that hold a token, and the full-text ranks times their weights."""
    like = like_top(questions, docs, id_column, {"like": weights}, k if fts is None else 4 * k).select("question_id", "id", "score")
    if fts is None:
        return like
    # whatever holds all words holds many tokens too; its own like score is taken from the pairs themselves
    ranks = [fts_match(questions, docs, id_column, c).select("question_id", "id", (F.col("score") * w).alias("fts")) for c, w in ({fts: 1.0} if isinstance(fts, str) else fts).items()]
    # written, so that the planner knows that they are few and doesn't shuffle the texts to meet them
    whole = cut(reduce(DataFrame.unionByName, ranks).groupBy("question_id", "id").agg(F.sum("fts").alias("fts")))
    texts = docs.select(F.col(id_column).alias("id"), *(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_{c}") for c in weights))
    tokens = questions.select("question_id", T.tokens(F.col("question")).alias("_tokens"))
    pairs = whole.join(texts, "id").join(tokens, "question_id")
    per = lambda t: reduce(lambda a, b: a + b, (F.when(F.contains(F.col(f"_{c}"), t), w).otherwise(0.0) for c, w in weights.items()))
    full = pairs.select("question_id", "id", (F.aggregate("_tokens", F.lit(0.0), lambda a, t: a + per(t)) + F.col("fts")).alias("score"))
    both = like.unionByName(full).groupBy("question_id", "id").agg(F.max("score").alias("score"))
    return top_k(both, k, "id").drop("rank")


def keep_relevant(hits: DataFrame) -> DataFrame:
    """The relevant hits of each question; all of them where none is relevant."""
    some = F.max(F.col("relevant").cast("int")).over(Window.partitionBy("question_id"))
    return hits.withColumn("_some", some).where(F.col("relevant") | (F.col("_some") == 0)).drop("_some")


#: Values of query vectors that are broadcast at a time.
MOST_VALUES = 8_000_000


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, places: int = 9) -> DataFrame:
    """question_id, id, score, rank: the k vectors of the largest cosine for each query (question_id, embedding); vectors of another width don't meet, those without a norm take no part.

    The queries are a stated set: blocks of at most ``MOST_VALUES`` numbers are broadcast, each task multiplies its vectors with
    a block and keeps the k best of each query, so the vectors themselves are never shuffled.
    """
    usable = lambda df, name: df.select(F.col(name).alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)")
    left, right = usable(queries, "question_id"), usable(vectors, "id")
    kind, asked = right.schema["id"].dataType.simpleString(), left.schema["id"].dataType.simpleString()
    n = left.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks, out = max(1, -(-2 * n // MOST_VALUES) if n > MOST_VALUES else 1), None
    for b in range(blocks):
        mine = left if blocks == 1 else left.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        part = right.mapInPandas(_nearest_of_task(spark_broadcast(right, [(r.id, r.v) for r in mine.collect()]), k, places), f"question_id {asked}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    return top_k(out, k, "id")


def _nearest_of_task(held, k: int, places: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        widths: dict[int, list] = {}
        for q, v in held.value:
            widths.setdefault(len(v), []).append((q, v))
        asked = {w: ([q for q, _ in rows], _unit(np.array([v for _, v in rows]))) for w, rows in widths.items()}
        best: dict[int, pd.DataFrame] = {}
        for frame in frames:
            width = frame["v"].map(len)
            for w, (_, q) in asked.items():
                rows = frame[width == w]
                for at in range(0, len(rows), 2048):
                    part = rows.iloc[at : at + 2048]
                    scores = np.round(q @ _unit(np.stack(part["v"])).T, places)
                    few = np.argsort(-scores, axis=1, kind="stable")[:, :k] if len(part) <= k else np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    least = np.take_along_axis(scores, few, 1).min(1)
                    i, j = np.nonzero(scores >= least[:, None])  # equal scores all stay, the ids decide
                    new = pd.DataFrame({"q": i, "id": part["id"].to_numpy()[j], "score": scores[i, j]})
                    both = pd.concat([best[w], new]) if w in best else new
                    both = both.sort_values(["q", "score", "id"], ascending=[True, False, True], kind="stable")
                    best[w] = both[both.groupby("q").cumcount() < k]
        for w, rows in best.items():
            yield pd.DataFrame({"question_id": [asked[w][0][q] for q in rows["q"]], "id": rows["id"].to_numpy(), "score": rows["score"].to_numpy()})

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def best_chunk(hits: DataFrame) -> DataFrame:
    """One hit per question and article: the best chunk, the earlier of equals; then ranked anew."""
    w = Window.partitionBy("question_id", "key").orderBy(F.desc("score"), "rank")
    best = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "key")))


def vector_worklist(articles: DataFrame, index: DataFrame, profile: str, dims: int) -> DataFrame:
    """key, content_hash, action: INDEX where the content, profile or width differs from what is indexed, else SKIP."""
    hashed = articles.select("key", F.sha2(F.col("content"), 256).alias("content_hash"))
    had = index.select("key", F.col("content_hash").alias("_h"), F.col("profile").alias("_p"), F.col("dims").alias("_d"))
    same = F.col("_h").eqNullSafe(F.col("content_hash")) & F.col("_p").eqNullSafe(F.lit(profile)) & F.col("_d").eqNullSafe(F.lit(dims))
    return hashed.join(had, "key", "left").select("key", "content_hash", F.when(same, "SKIP").otherwise("INDEX").alias("action"))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Adds ``place``, from 1, in a total order. Rows are sorted by range; a range's rows are counted on from the ranges before it, so none is sorted in one task."""
    sorted_ = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    return sorted_.join(F.broadcast(before.drop("_n")), "_part").withColumn("place", F.col("_before") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_first", "_before")


def text_search_config(available: list[str], preferred: str = "jiebacfg") -> str:
    """The analyser of full-text search: the preferred one where it is there, else ``simple``."""
    return preferred if preferred in available else "simple"
