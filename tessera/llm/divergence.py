"""How far the sources of a language differ in their words: a baseline-correction inverted index.

Each language keeps the V terms that stand in at least ``least`` of its documents. A group (language, source) gives a term
that it holds c times the share p(c) = 1 + floor(10**9 (c + 2) / (N + 2 V)), N being all its kept occurrences. Two groups
differ by the sum over all kept terms of f(p, q) = floor((p - q)**2 / (p + q)).

Most counts are zero, so a pair of groups starts at the baseline V f(p0, q0), as if all were. Corrections take it to the
true sum, term by term only where both groups hold the term:

* one-sided: a term that s holds c times, whatever t holds, adds f(p(c), q0) - f(p0, q0). That depends on c alone, so it is
  added for each count that occurs in s, times the number of terms that have it;
* two-sided: a term whose postings hold both adds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), from a join of the postings
  on (language, term), summed before it is shuffled.

All arithmetic is exact: integers, and decimals where 10**9 times a count could overflow. A task counts its documents in one
dictionary that is emptied when it is full; counts are added before they are shuffled, by (language, source, term), so a
source that holds a third of all rows, or a word that stands in all, is a few rows from each task. Windows rank the terms of
a group: tasks keep their first ten before they meet.

Null texts, languages and sources are ''; every row is a document, repeated rows too; a text is read whole. Languages in
which no term is frequent have pairs of value 0 and no terms; a language's only source has no pairs. Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices

#: Bytes of a term as they are, lower-cased; all others end it.
TERM = np.full(256, 32, np.uint8)
TERM[65:91] = np.arange(97, 123)
TERM[97:123] = np.arange(97, 123)
TERM[128:] = np.arange(128, 256)

#: (group, term) counts that a task holds before it sends them on.
HELD = 600_000

COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), and a row without a term for each (lang, source)."""
    terms: dict[str, int] = {}
    groups: dict[tuple[str, str], int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return key, *(np.bincount(inverse, np.concatenate([h[k] for h in held]), len(key)).astype(np.int64) for k in (1, 2))

    def sent() -> Iterator[pa.RecordBatch]:
        langs, sources, names = [g[0] for g in groups], [g[1] for g in groups], pa.array(list(terms), pa.string())
        none = np.zeros(len(groups), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.nulls(len(groups), pa.string()), pa.array(none), pa.array(none)], names=["lang", "source", "term", "n", "docs"])
        if held:
            key, n, docs = added()
            group, term = key >> 32, key & 0xFFFFFFFF
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                g = pa.array(group[part])
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(g), pa.array(sources, pa.string()).take(g), names.take(pa.array(term[part])), pa.array(n[part]), pa.array(docs[part])], names=["lang", "source", "term", "n", "docs"])
        terms.clear()
        groups.clear()
        held.clear()

    for batch, data, offsets in slices(batches, "text"):
        who = [groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        text = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(TERM[data])])
        lists = pc.ascii_split_whitespace(text)
        found = lists.flatten().dictionary_encode()
        number = np.array([terms.setdefault(t, len(terms)) if t else -1 for t in found.dictionary.to_pylist()], np.int64)
        term = number[found.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        doc, term = doc[term >= 0], term[term >= 0]
        in_doc, n = np.unique(doc << 32 | term, return_counts=True)
        key = np.array(who, np.int64)[in_doc >> 32] << 32 | in_doc & 0xFFFFFFFF
        held.append((key, n, np.ones(len(key), np.int64)))
        size += len(key)
        if size > 2 * HELD:
            held[:] = [added()]
            size = len(held[0][0])
            if size > HELD:
                yield from sent()
                size = 0
    if groups:
        yield from sent()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 kept)); null where nothing is kept."""
    big = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", big, (total + 2 * kept).cast("decimal(20,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Groups: lang, source, kept (V of the lang), p0. Postings: lang, term, source, p, p0, q (the lang's share)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, COUNTED)
    counts = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    w = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(w).alias("docs"), F.sum("n").over(w).alias("all"), F.min("source").over(w).alias("first"))
    kept = cut(kept.where(F.col("docs") >= least).select("lang", "source", "term", "n", "all", (F.col("first") == F.col("source")).cast("long").alias("first")))
    langs = kept.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("lang_total", F.lit(0)).cast("long").alias("lang_total"))
    groups = cut(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))
    joined = kept.join(groups, ["lang", "source"])
    postings = joined.select("lang", "term", "source", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), "p0", share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q"))
    return groups.drop("total", "lang_total"), cut(postings)


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """lang, a, b (a < b), value of all pairs of sources of a language."""
    a, b = (groups.select("lang", F.col("source").alias(x), "kept", F.col("p0").alias(f"{x}0")) for x in "ab")
    base = a.join(b.drop("kept"), "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("kept") * apart(F.col("a0"), F.col("b0")), F.lit(0)).alias("value"))
    levels = postings.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    one = levels.join(other, "lang").where("source != other")
    one = one.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("times") * (apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0")))).alias("value"))
    one = one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    a, b = (postings.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"{x}p"), F.col("p0").alias(f"{x}0")) for x in "ab")
    two = apart(F.col("ap"), F.col("bp")) - apart(F.col("ap"), F.col("b0")) - apart(F.col("a0"), F.col("bp")) + apart(F.col("a0"), F.col("b0"))
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(two).alias("value"))
    return base.unionByName(one).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part ('pair': the other sources, 'term': the ``top`` terms that a source favours), item, value, rank. Needs text, lang, source."""
    groups, postings = shares(docs, least)
    pairs = pair_values(groups, postings)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", sides.alias("side"), "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top))


#: The contract of the query: every group meets every kept term.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS all_n
  FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), totals AS (
  SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM cells GROUP BY ALL
), p AS (
  SELECT cells.lang, cells.source, term, n,
         1 + CAST(1000000000::HUGEINT * (n + 2) // (totals.total + 2 * v) AS BIGINT) AS p,
         1 + CAST(1000000000::HUGEINT * (all_n + 2) // (langs.total + 2 * v) AS BIGINT) AS q
  FROM cells JOIN totals ON totals.lang = cells.lang AND totals.source = cells.source JOIN langs ON langs.lang = cells.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
