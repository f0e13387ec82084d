"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Tokens are runs of letters, digits and bytes above 127, or runs of other visible characters. Features, hashed into
2**18 slots: a token, two successive tokens, and the shapes (case, digits, sign runs, whether the token repeats the one
or two before it) of three successive tokens. A feature's value is its share of the document's features times ``GAIN``,
so a score is one sparse dot product.

Training takes the ``max_rows`` labelled documents with the smallest hashes of doc_id, a documented bound that does not
grow with the corpus; one task runs the updates. The weights (1 MB) are broadcast and every whole text is scored in
Arrow batches, without a shuffle.

Null or empty texts have no features and get the bias alone; null doc_ids are scored, never trained on and never held
out; of contradicting labels of a doc_id the smallest counts; repeated rows are scored each; other columns are ignored.
Without any label all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, LOWER, documents_of, mix, prefix_sums, slices, span_hashes

BITS = 18
GAIN = 24.0
#: A text is read in pieces of about so many bytes, cut between tokens; each sees so many tokens before it, which its n-grams need.
PIECE = 1 << 21
BEFORE = 4

KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32, 0]] = 0
KIND[48:58] = KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1


def features(data: np.ndarray, offsets: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of the texts, and each text's first place in them (n+1 of them); without those that end in the first ``before`` tokens."""
    kind = KIND[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    change = np.ones(len(data), bool)
    change[1:] = (kind[1:] != kind[:-1]) | first[1 : len(data)]
    runs = np.flatnonzero(change)
    ends = np.append(runs[1:], len(data))
    shown = kind[runs] > 0
    starts, ends = runs[shown], ends[shown]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    owner = np.searchsorted(offsets, starts, "right") - 1
    h = span_hashes(prefix_sums(LOWER[data]), starts, ends)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    ups, length = upper[ends] - upper[starts], ends - starts
    shape = np.where(ups == 0, 1, np.where((ups >= 2) | (length == ups), 3, 2)).astype(np.uint64)
    shape[(digit[ends] - digit[starts]) > 0] = 4
    sign = kind[starts] == 2
    shape[sign] = 8 + h[sign] % np.uint64(1 << 20)
    same = lambda k: np.concatenate([np.zeros(min(k, len(h)), bool), (h[k:] == h[:-k]) & (owner[k:] == owner[:-k])])
    shape = shape * np.uint64(4) + same(1).astype(np.uint64) + np.uint64(2) * same(2)
    joined = lambda x, k: (owner[k:] == owner[:-k])
    b = np.uint64(BASE)
    kinds = [(h, owner)]
    if len(h) > 1:
        ok = joined(h, 1)
        kinds.append(((mix(h[:-1] * b + h[1:]))[ok], owner[1:][ok]))
    if len(h) > 2:
        ok = joined(h, 2)
        kinds.append((mix((shape[:-2] * b + shape[1:-1]) * b + shape[2:])[ok], owner[2:][ok]))
    kinds.append((mix(shape + np.uint64(77)), owner))
    if before:  # of one text: unigrams, bigrams, trigrams end where their last token stands
        kinds = [(x[max(0, before - k) :], who[max(0, before - k) :]) for (x, who), k in zip(kinds, (*range(len(kinds) - 1), 0), strict=True)]
    slot = np.concatenate([x for x, _ in kinds]) >> np.uint64(64 - BITS)
    who = np.concatenate([x for _, x in kinds])
    order = np.argsort(who, kind="stable")
    return slot[order].astype(np.int64), np.searchsorted(who[order], np.arange(len(offsets)))


def parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``features`` of a slice; a single long text comes in pieces whose features together are the whole text's."""
    if len(offsets) > 2 or len(data) <= PIECE:
        yield features(data, offsets)
        return
    kind = KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    starts = np.flatnonzero(change & (kind > 0))
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        before = min(BEFORE, at)
        piece = data[starts[at - before] : starts[stop] if stop < len(starts) else len(data)]
        yield features(piece, np.array([0, len(piece)]), before)
        at = stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in slices(batches, "text"):
        found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for slot, at in parts(data, offsets):
            for i in range(batch.num_rows):
                found[i].append(slot[at[i] : at[i + 1]])
        each = [np.unique(np.concatenate(x), return_counts=True) for x in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([x.tolist() for x, _ in each], pa.list_(pa.int32())), pa.array([(n / max(1, n.sum()) * GAIN).tolist() for _, n in each], pa.list_(pa.float32()))],
            names=["doc_id", "y", "slots", "counts"],
        )


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights (the last is the bias) after ``epochs`` passes of per-coordinate FTRL-proximal updates over (label, slots, values)."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for y, slots, values in rows:
            i, x = np.append(slots, 1 << BITS), np.append(values, 1.0)
            w = weights(z[i], n[i])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(z, n).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.5) -> np.ndarray:
    """Weights learnt from labels (doc_id, label 0 or 1) of documents (doc_id, text), at most ``max_rows`` of them."""
    spread = F.xxhash64("doc_id")
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(spread, "doc_id").limit(max_rows)
    rows = documents_of(docs).join(F.broadcast(chosen.select("doc_id", F.col("label").cast("int").alias("y"))), "doc_id").select("doc_id", "text", "y")
    counted = rows.mapInArrow(_counted, "doc_id long, y int, slots array<int>, counts array<float>")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for d, y, s, c in zip(frame["doc_id"], frame["y"], frame["slots"], frame["counts"], strict=True):
                kept.setdefault(int(d), (int(y), np.asarray(s, np.int64), np.asarray(c, np.float64)))
        order = sorted(kept, key=lambda d: (int(mix(np.array([d & (1 << 64) - 1], np.uint64))[0]), d))
        yield pd.DataFrame({"weights": [ftrl([kept[d] for d in order], epochs, alpha, beta, l1, l2).tobytes()]})

    found = counted.repartition(1).mapInPandas(fit, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, keep_text: bool = False, name: str = "score") -> DataFrame:
    """All columns of docs, without its text unless asked for, and ``name``: the score (0 to 1); a column of docs called so goes."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value.astype(np.float64)
        for batch, data, offsets in slices(batches, "text"):
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for slot, at in parts(data, offsets):
                sums = np.concatenate([[0.0], np.cumsum(w[slot])])
                total += sums[at[1:]] - sums[at[:-1]]
                n += at[1:] - at[:-1]
            s = 1 / (1 + np.exp(-np.clip(w[-1] + GAIN * total / np.maximum(n, 1), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), pa.array(s)], names=[*kept, name])

    kept = [c for c in docs.columns if (keep_text or c != "text") and c.lower() != name.lower()]
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema if f.name in kept]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; trained on labels.quality of rows that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out())
    weights = train(docs, known, **params)
    scored = score(documents_of(docs), weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
