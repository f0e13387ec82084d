"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

DataFrame functions only. Three pattern kinds (assign, access, hex) give the base spans. The models add spans of kind
``random``: runs of 20 or more key characters, apart from all base spans, whose log-likelihood ratio is at least
``threshold``.

The models are first-order transition tables over 65 symbols, trained from labelled samples: random strings (hexadecimal,
base-64 and base-36 digests of a range of numbers) against ordinary ones (the words of the ``sample_docs`` documents with the smallest
hashes of doc_id, a documented bound, as they stand and in upper case, plain numbers, bars of one character). Only the 65 x 65 counts per
label reach the driver. Every whole text is then scanned, row by row, without a shuffle.

Positions are code points, ends exclusive. Null and empty texts have no span; repeated rows and null doc_ids are scanned
each; other columns are ignored; with no documents the ordinary model is of numbers alone and there is no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of

#: The fixed patterns of the base kinds, in the order in which spans of one start are listed.
KINDS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: A cheaper pattern that some match of the kind passes if and only if one counts; for access and hex it finds exactly those that count.
SURE = {"assign": KINDS["assign"], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
RUN = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"  # any other character is the last symbol
N = len(SYMBOLS)


NONE_TYPE = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches for which keep(match) holds.

    A match starts where the texts between matches and the matches before it end. The running sum is taken over blocks of
    about the root of the number of matches, so that no array is copied for each match.
    """
    NONE = F.from_json(F.lit("[]"), NONE_TYPE)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    length = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = acc["at"] + length(x)
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def of_block(items: Column, at: Column) -> Column:
        return F.aggregate(items, F.struct(at.alias("at"), NONE.alias("out")), step, lambda acc: acc["out"])

    def by_blocks(items: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(items) / width).cast("int") - 1), lambda k: F.slice(items, k * width + 1, width))
        sized = F.transform(blocks, lambda b: F.struct(b.alias("items"), F.aggregate(b, F.lit(0), lambda a, x: a + length(x)).alias("n")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(sized, zero, lambda acc, b: F.struct((acc["at"] + b["n"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, begins, of_block))

    # lambda variables stand for what would else be written out again at each use
    whole = F.get(F.transform(F.array(found), lambda items: F.when(F.size(items) <= 64, of_block(items, F.lit(0))).otherwise(by_blocks(items))), 0)
    return F.when(text.rlike(pattern), whole).otherwise(NONE)


def base_spans(text: Column) -> list[Column]:
    long_value = lambda hit: F.length(F.regexp_extract(hit, KINDS["assign"], 2)) >= 6
    sure = lambda hit: F.lit(True)
    return [spans(text, SURE[k], i, long_value if k == "assign" else sure) for i, k in enumerate(KINDS)]


def _pairs(words: DataFrame, label: int) -> DataFrame:
    """label, two successive symbols, count."""
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    return each.groupBy("pair").count().select(F.lit(label).alias("label"), "pair", "count")


def train(docs: DataFrame, sample_docs: int = 2000, samples: int = 4000) -> list[list[float]]:
    """Log-likelihood ratios random against ordinary: N+1 rows of N+1."""
    spark = docs.sparkSession
    rows = documents_of(docs)
    chosen = rows.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    text = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", KINDS["assign"], " "), SURE["access"], " "), SURE["hex"], " ").alias("text"))
    word = text.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_/=+-]{4,}"), F.lit(0))).alias("word")).where("length(word) < 20")  # longer ones may be what is looked for
    ids = spark.range(samples)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    number = ids.select(F.substring(F.translate(digest, "abcdef", "123456"), 1, 16).alias("word"))
    bar = ids.where(f"id < {10 * N}").select(F.repeat(F.substring(F.lit(SYMBOLS), (F.col("id") % N + 1).cast("int"), F.lit(1)), F.lit(30)).alias("word"))
    ordinary = word.unionByName(word.select(F.upper("word").alias("word"))).unionByName(number).unionByName(bar)
    base36 = F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))
    random = ids.select(digest.alias("word")).unionByName(ids.select(F.regexp_replace(F.base64(F.unhex(digest)), r"[\s=]", "").alias("word"))).unionByName(ids.select(base36.alias("word")))
    counts = [[[0.02] * (N + 1) for _ in range(N + 1)] for _ in range(2)]
    at = {c: i for i, c in enumerate(SYMBOLS)}
    for label, pair, count in _pairs(ordinary.where("length(word) > 1"), 0).unionByName(_pairs(random.where("length(word) > 1"), 1)).collect():  # two tables of 65 x 65 at most
        counts[label][at.get(pair[0], N)][at.get(pair[1], N)] += count
    chance = []
    for t in counts:  # transitions seldom seen lean on how frequent the second symbol is
        total = sum(map(sum, t))
        each = [sum(row[j] for row in t) / total for j in range(N + 1)]
        chance.append([[math.log((x + 8 * each[j]) / (sum(row) + 8)) for j, x in enumerate(row)] for row in t])
    return [[b - a for a, b in zip(x, y, strict=True)] for x, y in zip(*chance, strict=True)]


def _ratio(word: Column, table: list[list[float]]) -> Column:
    """The word's log-likelihood ratio."""
    flat = F.split(F.lit(",".join(f"{x:.6f}" for row in table for x in row)), ",").cast("array<double>")
    code = {c: i for i, c in enumerate(SYMBOLS)}
    number = F.split(F.lit(",".join(str(code.get(chr(i), N)) for i in range(128))), ",").cast("array<int>")
    symbol = lambda i: F.get(number, F.ascii(F.substring(word, i, F.lit(1))))
    return F.aggregate(F.sequence(F.lit(2), F.length(word)), F.lit(0.0), lambda acc, i: acc + F.get(flat, symbol(i - 1) * (N + 1) + symbol(i)))


def scan(docs: DataFrame, table: list[list[float]], threshold: float = 12.0) -> DataFrame:
    """doc_id and spans array<struct<start, kind, end>> of every row, sorted; kind 3 is ``random``."""
    text = F.col("text")
    base = documents_of(docs).select("doc_id", "text", F.array_sort(F.concat(*base_spans(text))).alias("base"))
    runs = spans(text, RUN, 3, lambda hit: _ratio(hit, table) >= threshold)
    apart = F.filter(runs, lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return base.select("doc_id", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def _written(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "random")))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every document."""
    found = scan(docs, train(docs, **params))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), count(3).alias("n_random"))
