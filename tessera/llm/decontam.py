"""Benchmark decontamination: rare n-gram seeds join documents with items, then Smith-Waterman alignment.

Benchmark items become words. Of each two adjacent word n-grams of an item the one that fewer documents hold (the first of
two equal ones) is a seed, so common n-grams fall away wherever a rarer one stands beside them, and still every stretch of
n+1 words that an edit left whole holds a seed. The seeds are a table that is joined with the n-grams of the documents, of
which a bitmap of fixed size lets through those that some item holds. Around the places where a text meets an item, a
passage of the text is aligned with the item by Smith-Waterman over words (match 2, mismatch -1, gap -1). The score is the
best local alignment's over the item's best possible; from ``threshold`` on the document counts as contaminated, which a
verbatim half of an item reaches as well as an edited or paraphrased whole. Passages whose words can't reach it, in any
order, aren't aligned; that loses nothing and is what common n-grams cost.

Equal texts are judged once, under their SHA-256, so a text that a third of all rows repeat is one. Only texts that meet an
item are shuffled. A task holds one text's words and lets the items that it meets pass. Nothing is collected but the bitmaps;
the joins of seeds, items and results are broadcast by Spark only where their measured size is small.

Items of fewer than ``least`` words match only verbatim, those of fewer than 4 never. Null or empty texts match nothing;
null ids stay null; repeated documents get the same matches, items with equal id and text count once. A very long text is
aligned in pieces around its hits. An empty benchmark or table of documents is no error. Other columns of the documents are
kept, whatever their names, but for one called like the column that ``mark`` adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_of, cut, free, in_bitmap, ngrams, prefix_sums, slices, span_hashes, words

GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = GAP[128:] = False
MATCHES = "array<struct<item_id:bigint,score:double,word:bigint,n_words:bigint>>"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts, and each text's first (n+1 of them)."""
    from .common import utf8

    data, offsets = utf8(pc.utf8_lower(column))
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, first = words(data, offsets, GAP)
    return span_hashes(prefix_sums(data), starts, ends), first


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and where in the passage it ends."""
    n = len(passage)
    step = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    best, where = 0, 0
    for w in item:
        up = np.zeros(n + 1, np.int64)
        up[1:] = np.maximum(row[:-1] + np.where(passage == w, 2, -1), row[1:] - 1)
        np.maximum(up, 0, out=up)
        row = np.maximum.accumulate(up + step) - step  # gaps in the item: -1 for each word skipped
        top = int(row.argmax())
        if row[top] > best:
            best, where = int(row[top]), top - 1
    return best, where


def reachable(kinds: np.ndarray, times: np.ndarray, passage: np.ndarray) -> int:
    """No alignment of an item (its different words and how often each occurs) with the passage has more matches than this."""
    passage = np.sort(passage)
    held = np.searchsorted(passage, kinds, "right") - np.searchsorted(passage, kinds, "left")
    return int(np.minimum(held, times).sum())


def align(item: np.ndarray, text: np.ndarray, hits: np.ndarray, least: float = 0.0) -> tuple[int, int]:
    """The best alignment near the hits (word places) if it scores ``least``: windows of an item's length and a half about each, long runs of them in pieces that overlap by two item lengths."""
    m = len(item)
    best = (0, 0)
    kinds, times = np.unique(item, return_counts=True)
    lows, highs = np.maximum(0, hits - m - m // 2), np.minimum(len(text), hits + m + m // 2 + 4)
    gaps = np.flatnonzero(lows[1:] > highs[:-1]) + 1
    for low, high in zip(lows[np.append(0, gaps)], highs[np.append(gaps - 1, len(hits) - 1)], strict=True):
        for at in range(int(low), int(high), 8 * m):
            piece = text[at : min(int(high), at + 10 * m)]
            most = 2 * reachable(kinds, times, piece)
            if most < least or most <= best[0]:
                continue
            score, where = smith_waterman(item, piece)
            if score > best[0]:
                best = score, at + where
            if best[0] == 2 * m:
                return best
    return best


def _grams(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams within the texts of a batch, their rows, their places in the row's words, and the row's number of words."""
    h, first = word_hashes(batch.column(batch.schema.names.index("text")))
    grams = ngrams(h, n)
    at = np.arange(len(grams))
    row = np.searchsorted(first, at, "right") - 1
    inside = at + n <= first[row + 1]
    return grams[inside], row[inside], (at - first[row])[inside], np.diff(first)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _of_items(n: int, shortest: int):
    """item, place, gram of all n-grams of items of at least ``shortest`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            gram, row, place, size = _grams(batch, n)
            long = size[row] >= shortest
            item = batch.column(batch.schema.names.index("item")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(item[row[long]]), pa.array(place[long]), _signed(gram[long])], names=["item", "place", "gram"])

    return run


def _counted(bits, n: int):
    """gram, n: how many rows hold each n-gram that the bitmap lets through, summed within each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            gram, row, _, _ = _grams(batch, n)
            held = in_bitmap(bits.value, gram)
            gram, row = gram[held], row[held]
            order = np.lexsort((gram, row))
            gram, row = gram[order], row[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            gram, times = np.unique(gram[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(gram), pa.array(times)], names=["gram", "n"])

    return run


def _met(bits, n: int):
    """key, gram, places: where each text holds the n-grams that the bitmap lets through; a slice's equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            key = batch.column(batch.schema.names.index("key"))
            once = np.sort(np.unique(np.array(key.to_pylist(), object), return_index=True)[1])
            batch = batch.take(pa.array(once))
            gram, row, place, _ = _grams(batch, n)
            held = in_bitmap(bits.value, gram)
            gram, row, place = gram[held], row[held], place[held]
            order = np.lexsort((place, gram, row))
            gram, row, place = gram[order], row[order], place[order]
            new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]))) if len(gram) else np.zeros(0, np.int64)
            places = pa.ListArray.from_arrays(pa.array(np.append(new, len(gram)).astype(np.int32)), pa.array(place))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("key")).take(pa.array(row[new])), _signed(gram[new]), places], names=["key", "gram", "places"])

    return run


def _kept(bits):
    """The rows whose ``short`` the bitmap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column(batch.schema.names.index("short")).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(in_bitmap(bits.value, short)))

    return run


def _aligned(threshold: float, least: int):
    """Streams rows sorted by (key, role, item): holds a text's words (role 0), and lets the items that it meets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch, _, _ in slices(batches, "text"):
            found: list[tuple] = []
            words_, first = word_hashes(batch.column(batch.schema.names.index("text")))
            keys, ids, places = (batch.column(batch.schema.names.index(c)) for c in ("key", "item_id", "places"))
            role = batch.column(batch.schema.names.index("role")).to_numpy()
            for i in range(batch.num_rows):
                mine, key = words_[first[i] : first[i + 1]], keys[i].as_py()
                if role[i] == 0:
                    held = mine.copy()
                    continue
                wants = threshold if len(mine) >= least else 1.0
                hits = np.unique(places[i].values.to_numpy())
                score, where = align(mine, held, hits, wants * 2 * len(mine) - 1e-6)
                share = score / (2 * len(mine))
                if share >= wants:
                    found.append((key, ids[i].as_py(), round(share, 6), int(where), len(mine)))
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "item_id", "score", "word", "n_words"])

    return run


#: Items of fewer words never match.
SHORTEST = 4


def seeds(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """gram, item: of each two adjacent n-grams of an item the one that fewer texts hold (of equal ones the first); those that no text holds can't meet any and are left out."""
    grams = cut(items.select("item", "text").mapInArrow(_of_items(n, SHORTEST), "item long, place long, gram long"))
    bits = texts.sparkSession.sparkContext.broadcast(bitmap_of(grams, "gram"))
    counts = texts.select("text").mapInArrow(_counted(bits, n), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    along = Window.partitionBy("item").orderBy("place")
    before, after = F.lag("n").over(along), F.lead("n").over(along)
    rare = (before.isNull() & after.isNull()) | (F.col("n") < before) | (F.col("n") <= after)
    return counted.withColumn("rare", rare).where("rare and n > 0").select("gram", "item").distinct()


def found(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, least: int = 8) -> DataFrame:
    """key, item_id, score, word, n_words: the items that the text with the SHA-256 ``key`` holds, the word where the alignment ends, and the item's words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    rare = cut(seeds(texts, items, n))
    bits = spark.sparkContext.broadcast(bitmap_of(rare, "gram"))
    keyed = texts.withColumn("key", F.sha2("text", 256))
    hits = keyed.mapInArrow(_met(bits, n), "key string, gram long, places array<long>").groupBy("key", "gram").agg(F.first("places").alias("places"))
    # the places of a text's seeds are at most its words
    meets = cut(hits.join(rare, "gram").groupBy("key", "item").agg(F.flatten(F.collect_list("places")).alias("places")))
    short = spark.sparkContext.broadcast(bitmap_of(meets.select(F.xxhash64("key").alias("short")).distinct(), "short"))
    wanted = keyed.select("key", "text", F.xxhash64("key").alias("short")).mapInArrow(_kept(short), "key string, text string, short long")
    wanted = wanted.groupBy("key").agg(F.first("text").alias("text"))
    whole = wanted.select("key", F.lit(0).alias("role"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("item_id"), "text", F.lit(None).cast("array<long>").alias("places"))
    asked = meets.join(items, "item").select("key", F.lit(1).alias("role"), "item", "item_id", "text", "places")
    dealt = whole.unionByName(asked).repartition("key").sortWithinPartitions("key", "role", "item")
    return dealt.mapInArrow(_aligned(threshold, least), "key string, item_id long, score double, word long, n_words long")


def mark(docs: DataFrame, benchmark: DataFrame, name: str = "matches", **params) -> DataFrame:
    """All columns of docs, and ``name`` (of a column of docs called so nothing is left): the benchmark items that each row holds, with score, the word where the alignment ends and the item's words."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    key = free(docs.withColumn(name, F.lit(None)), "key")
    entry = F.struct("item_id", "score", "word", "n_words")
    matches = cut(found(docs, benchmark, **params).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_list(entry)).alias(name)))
    rows = docs.drop(name).withColumn(key, F.sha2("text", 256)).join(matches, key, "left").drop(key)
    return rows.withColumn(name, F.coalesce(F.col(name), F.from_json(F.lit("[]"), MATCHES)))


def contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, item_id, score, word, n_words of every contaminated document and item."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("string"), 256).alias("key"))
    return keys.join(cut(found(docs, benchmark, **params)), "key").select("doc_id", "item_id", "score", "word", "n_words")
