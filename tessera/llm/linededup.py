"""Line dedup: content-defined chunks of lines, repeated chunks removed. DataFrame functions only.

A line's hash is the first 32 bits of its MD5, and a rolling hash runs over two line hashes; a chunk ends where the rolling
hash is smaller than those of the lines before and after. Two such places are never neighbours, so a chunk has two lines
or more (the first line and the last but one end none), and a border depends on nothing but the four lines around it: the
same passage is cut the same way wherever it is shifted to, but for its edges. A run of equal lines isn't cut. A chunk of two or more lines with some visible
character that occurs more than once in the corpus is kept at its first place (smallest doc_id, then first line) and
removed from all others.

Chunks first meet by a 64-bit hash alone; only those whose hash occurs again are compared by their bytes, as keys of an
aggregate that each task combines before it shuffles. What a frequent chunk's occurrences are then told is one row, in a
join that Spark can split. No group is ever gathered but the removed chunks of one document.

Null texts are empty (and stay null); a null doc_id comes after all others; rows that share doc_id and text are treated
alike (each of them keeps the first places that their doc_id holds). A text of one line has no chunk; very long texts
cost time and memory in proportion to their lines. Other columns pass through unchanged, whatever their names; only
columns called as the two counts that ``dedup`` adds are replaced. Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, cut, free

LAST = (1 << 63) - 1


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``lines`` and ``chunks``: array<struct<first, n>> of line numbers from 0."""
    rows = docs.select("doc_id", "text").withColumn("lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1))
    rows = rows.withColumn("hashes", F.transform("lines", line_hash))
    before = lambda i: F.when(i > 0, F.get("hashes", i - 1)).otherwise(0)
    rows = rows.withColumn("rolling", F.transform("hashes", lambda h, i: (h + 31 * before(i)) % (1 << 32)))
    last = F.size("rolling") - 1
    least = lambda i: (F.get("rolling", i) < F.get("rolling", i - 1)) & (F.get("rolling", i) < F.get("rolling", i + 1))
    closes = lambda i: (i == last) | ((i > 0) & (i < last - 1) & least(i))
    rows = rows.withColumn("ends", F.filter(F.sequence(F.lit(0), last), closes))
    start = lambda k: F.when(k > 0, F.get("ends", k - 1) + 1).otherwise(0)
    chunk = lambda e, k: F.struct(start(k).alias("first"), (e - start(k) + 1).alias("n"))
    return rows.withColumn("chunks", F.transform("ends", chunk)).drop("hashes", "rolling", "ends")


def _occurrences(docs: DataFrame) -> DataFrame:
    rows = with_chunks(docs.select("doc_id", "text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "lines", F.filter("chunks", lambda c: c["n"] > 1).alias("chunks"))
    each = rows.select("doc_id", "text_hash", "lines", F.explode_outer("chunks").alias("c")).where("c is not null")  # outer: else a filter on the chunks' number would repeat their whole expression below
    each = each.select(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("doc"), "text_hash", F.col("c.first").alias("first"), F.col("c.n").alias("n"), F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.n")), "\n").alias("chunk"))
    return each.where(F.col("chunk").rlike(r"[^\s]")).withColumn("hash", F.xxhash64("chunk"))


def removed(docs: DataFrame) -> DataFrame:
    """doc, text_hash, gone: array<struct<first, n>> of the chunks that leave a document; documents without any are absent."""
    each = _occurrences(docs)
    again = each.groupBy("hash").count().where("count > 1").select("hash")
    repeated = cut(each.join(again, "hash"))
    places = repeated.groupBy("hash", "chunk", "doc").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    kept = places.groupBy("hash", "chunk").agg(F.min("doc").alias("home"), F.min_by("first", "doc").alias("line"), F.sum("n").alias("n")).where("n > 1").select("hash", "chunk", "home", "line")
    told = repeated.join(kept, ["hash", "chunk"]).where("doc != home or first != line")
    return told.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("gone"))


def dedup(docs: DataFrame, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """All columns of docs with ``text`` rid of repeated chunks, and the numbers of its lines and removed lines under the given names."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    doc, text_hash, gone = (free(docs, x) for x in ("doc", "text_hash", "gone"))
    told = removed(docs.select("doc_id", "text")).toDF(doc, text_hash, gone)
    rows = docs.withColumn(doc, F.coalesce("doc_id", F.lit(LAST))).withColumn(text_hash, F.xxhash64("text")).join(told.hint("shuffle_hash"), [doc, text_hash], "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # what stays: the lines before, between and after the removed chunks, which come sorted
    until = lambda k: F.coalesce(F.get(gone, k)["first"], F.size(lines))
    since = lambda k: F.when(k > 0, F.get(gone, k - 1)["first"] + F.get(gone, k - 1)["n"]).otherwise(0)
    stays = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, since(k) + 1, until(k) - since(k))))
    count = F.coalesce(F.aggregate(gone, F.lit(0), lambda a, g: a + g["n"]), F.lit(0)).cast("long")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias("text")
    passed = [text if name == "text" else c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name.lower() not in (n_lines.lower(), n_removed.lower())]
    return rows.select(*passed, F.size(lines).cast("long").alias(n_lines), count.alias(n_removed))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), hashed AS (
  SELECT doc_id, lines, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM lines
), rolled AS (
  SELECT doc_id, lines, list_transform(range(1, len(h) + 1), lambda i: (h[i] + 31 * CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END) % 4294967296) AS r FROM hashed
), ended AS (
  SELECT doc_id, lines, list_filter(range(1, len(r) + 1), lambda i: i = len(r) OR (i > 1 AND i < len(r) - 1 AND r[i] < r[i - 1] AND r[i] < r[i + 1])) AS ends FROM rolled
), each AS (
  SELECT doc_id, lines, unnest(ends) AS e, unnest(list_prepend(0, ends[:-2])) AS s FROM ended
), chunks AS (
  SELECT doc_id, s, e - s AS n, array_to_string(lines[s + 1 : e], chr(10)) AS chunk FROM each
), placed AS (
  SELECT *, count(*) OVER (PARTITION BY chunk) AS times, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, s) AS place
  FROM chunks WHERE n > 1 AND regexp_matches(chunk, '[^\\s]')
), gone AS (
  SELECT doc_id, s, n FROM placed WHERE times > 1 AND place > 1
), kept AS (
  SELECT c.doc_id, c.s, c.n, c.chunk, g.s IS NOT NULL AS leaves FROM chunks c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.s = g.s
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE leaves), 0)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(chunk, chr(10) ORDER BY s) FILTER (WHERE NOT leaves), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""
