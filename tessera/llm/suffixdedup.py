"""Suffix-array dedup: every byte that a repeated string of ``DEPTH`` bytes covers is removed.

Spark deals the strings' start positions (the suffixes) into buckets, tasks sort them block by block with a difference
cover.

1. Dealing. A string's anchor is the leftmost smallest fingerprint among the ``SPAN``-byte fingerprints that it holds (winnowing), and
   the bytes common to all strings that have the anchor at nearly the same place are its bucket's key: equal strings have equal keys. A first pass
   writes each text's keys and counts them, and only buckets that hold more than one place go on; the rest of the corpus
   is never shuffled, and later passes look for anchors only in texts that hold such a bucket. Buckets of more than
   ``HOT`` places are split by their next bytes, twice if need be, until each of their strings is a bucket of its own.
2. Sorting. A task takes a block of whole buckets at a time, so its memory is bounded by ``BLOCK`` bytes and one bucket
   of at most ``HOT`` places; what equals the row before it byte for byte is a repeat at once and isn't held.
   Positions of the block whose place modulo ``PERIOD`` lies in a difference cover are ranked first, by doubling; then
   all suffixes are sorted by their first 32 bytes, and ties, which are the rule among repeats, are resolved by the ranks of
   two cover positions at equal distance, never by scanning on. Neighbours in this order that share ``DEPTH`` bytes, compared
   byte for byte, mark both their strings.
3. Texts that are equal as a whole are one text in both passes; if they are long enough all their bytes go.

Null texts are empty; texts below ``DEPTH`` bytes stay whole; null doc_ids stay null; repeated rows are equal texts.
Other columns are ignored; an empty table gives no rows. Very long texts are read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, cut, documents_of, drop_cut, in_bitmap, mix, prefix_sums, slices, span_hashes
from .jaccard import binary_of

DEPTH = 400
SPAN = 64
REACH = DEPTH - SPAN + 1  # fingerprints in a string
#: Anchors' places within strings, so many to a bucket; of hot buckets fewer, at last one.
STEPS = (128, 32, 1)
BLOCK = 3 << 20
HOT = 4096
#: A difference cover: every distance modulo PERIOD is one between two members.
PERIOD = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
#: For two residues, the least shift that brings both into the cover.
SHIFT = np.array([[next(s for s in range(PERIOD) if (a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])
PLACE = np.full(PERIOD, -1)
PLACE[COVER] = np.arange(len(COVER))


def sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Minima or maxima of n successive values; len(x)-n+1 of them."""
    pick, fill = (np.minimum, np.uint64((1 << 64) - 1)) if least else (np.maximum, np.uint64(0))
    m = len(x) - n + 1
    rows = np.full(-(-len(x) // n) * n, fill, np.uint64)
    rows[: len(x)] = x
    rows = rows.reshape(-1, n)
    ahead = pick.accumulate(rows, axis=1).ravel()
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:m], ahead[n - 1 : n - 1 + m])


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts that share an anchor: first start, last start, anchor; and the prefix sums of the bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < DEPTH:
        return none, none, none, np.zeros(1, np.uint64)
    prefix = prefix_sums(data)
    at = np.arange(len(data) - SPAN + 1)
    h = np.maximum(span_hashes(prefix, at, at + SPAN), np.uint64(1))
    least = sliding(h, REACH, True)
    starts = len(least)
    valid = np.zeros(starts, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= DEPTH:
            valid[a : b - DEPTH + 1] = True
    if not valid.any():
        return none, none, none, prefix
    least[~valid] = 0
    chosen = h == sliding(np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)]), REACH, False)[: len(h)]
    places = np.flatnonzero(chosen)
    p = np.flatnonzero(valid)
    k = (np.cumsum(chosen) - chosen)[p]  # the first chosen place at or after the start
    todo = np.arange(len(p))
    while len(todo):
        todo = todo[h[places[k[todo]]] != least[p[todo]]]
        k[todo] += 1
    first = np.ones(len(p), bool)
    first[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)
    cuts = np.flatnonzero(first)
    return p[cuts], p[np.append(cuts[1:], len(p)) - 1], places[k[cuts]], prefix


class Runs:
    """Runs of string starts of one bucket each: key, first and last start, anchor."""

    def __init__(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray):
        self.key, self.low, self.high, self.anchor = key, low, high, anchor

    def __len__(self) -> int:
        return len(self.key)

    def __getitem__(self, some: np.ndarray) -> Runs:
        return Runs(self.key[some], self.low[some], self.high[some], self.anchor[some])


def dealt(prefix: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, step: int) -> Runs:
    """Runs cut where the distance to the anchor passes a multiple of step; the key is of the bytes that all strings of such a distance have in common."""
    found = []
    for c in range(int((anchor - high).min(initial=0)) // step, int((anchor - low).max(initial=-1)) // step + 1):
        a, b = np.maximum(low, anchor - step * c - step + 1), np.minimum(high, anchor - step * c)
        ok = np.flatnonzero(a <= b)
        common = anchor[ok] - step * c
        key = mix(span_hashes(prefix, common, np.minimum(common + DEPTH - step + 1, len(prefix) - 1)) + np.uint64(c + (step << 16)))
        found.append((key, a[ok], b[ok], anchor[ok]))
    none = np.zeros(0, np.int64)
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Runs(none.view(np.uint64), none, none, none)


def bucketed(data: np.ndarray, offsets: np.ndarray) -> tuple[Runs, np.ndarray]:
    """All runs, and the prefix sums of the bytes."""
    low, high, anchor, prefix = anchored(data, offsets)
    return dealt(prefix, low, high, anchor, STEPS[0]), prefix


def refined(runs_: Runs, prefix: np.ndarray, hots: list, tier: int) -> Runs:
    """The runs of the given tier: those of hot buckets of the tiers before it."""
    for k in range(tier):
        runs_ = runs_[in_bitmap(hots[k].value, runs_.key)]
        runs_ = dealt(prefix, runs_.low, runs_.high, runs_.anchor, STEPS[k + 1])
    return runs_


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A slice, or a single long text in pieces that share all but one byte of a string; with the place of their first byte."""
    if len(offsets) > 2 or len(data) <= most:
        yield data, offsets, 0
    else:
        for at in range(0, len(data) - DEPTH + 1, most):
            piece = data[at : at + most + DEPTH - 1]
            yield piece, np.array([0, len(piece)]), at


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts in lexical order of at least DEPTH bytes from there, and for each whether it shares DEPTH bytes with the one before it."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(640, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 600, np.uint64)
    for j in range(8):
        word |= padded[j : j + n + 600] << np.uint64(56 - 8 * j)
    # ranks of the cover's positions: 32 bytes, then doubled to 497
    rows = -(-n // PERIOD) + 1
    sample = (np.arange(rows)[:, None] * PERIOD + COVER).ravel()
    inside = np.minimum(sample, n)
    rank = np.unique(word[inside], return_inverse=True)[1].astype(np.uint64)
    for j in (8, 16, 24):
        rank = np.unique(rank << np.uint64(32) | np.unique(word[np.minimum(inside + j, n + 599)], return_inverse=True)[1].astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    for t in (1, 2, 4, 8):
        ahead = np.zeros(len(rank), np.uint64)
        ahead[: len(rank) - t * len(COVER)] = rank[t * len(COVER) :] + np.uint64(1)
        rank = np.unique(rank << np.uint64(32) | ahead, return_inverse=True)[1].astype(np.uint64)
    rank = rank.astype(np.int64)
    ranked = lambda x: rank[x // PERIOD * len(COVER) + PLACE[x % PERIOD]]

    order = starts[np.lexsort([word[starts + j] for j in (24, 16, 8, 0)])]
    new = np.ones(len(order), bool)
    new[1:] = False
    for j in (0, 8, 16, 24):
        w = word[order + j]
        new[1:] |= w[1:] != w[:-1]
    tied = ~new
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    open_ = np.flatnonzero(size[group] > 1)
    own = group[open_]
    while len(open_):
        head = np.ones(len(open_), bool)
        head[1:] = own[1:] != own[:-1]
        x = order[open_]
        pivot = x[np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))]
        s = SHIFT[x % PERIOD, pivot % PERIOD]
        side = np.sign(ranked(x + s) - ranked(pivot + s)) + 1
        key = own * 3 + side
        by = np.argsort(key, kind="stable")
        order[open_] = x[by]
        key = key[by]
        _, own, size = np.unique(key, return_inverse=True, return_counts=True)
        keep = (size[own] > 1) & (key % 3 != 1)
        open_, own = open_[keep], own[keep]
    same = np.flatnonzero(tied)
    for j in range(0, DEPTH, 8):
        same = same[word[order[same] + j] == word[order[same - 1] + j]]
    equal = np.zeros(len(order), bool)
    equal[same] = True
    return order, equal


def repeated(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the starts of DEPTH-byte strings that occur at two places of the texts."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    text = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([np.arange(a, b - DEPTH + 1) for a, b in zip(begin, ends, strict=True)])
    order, equal = suffix_order(text, starts)
    hit = equal.copy()
    hit[:-1] |= equal[1:]
    found = np.sort(order[hit])
    at = np.searchsorted(found, np.append(begin, ends[-1]))
    return [found[at[i] : at[i + 1]] - begin[i] for i in range(len(texts))]


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans that the strings at sorted starts cover, merged where they touch."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > DEPTH)
    return list(zip(starts[np.append(0, cuts + 1)].tolist(), (starts[np.append(cuts, len(starts) - 1)] + DEPTH).tolist(), strict=True))


def text_id(data: bytes) -> bytes:
    return hashlib.md5(data, usedforsecurity=False).digest()


def _texts(batches: Iterator[pa.RecordBatch], wanted=None) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Ids, bytes and offsets of texts of at least DEPTH bytes, equal ones once in each task. wanted: broadcast bitmap of the ids' first bytes; other texts are left out."""
    seen: set[bytes] = set()
    for batch, data, offsets in slices(batches, "text"):
        ids, parts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= DEPTH and (t := text_id(data[a:b].tobytes())) not in seen and (wanted is None or in_bitmap(wanted.value, short([t])).all()):
                seen.add(t)
                ids.append(t)
                parts.append(data[a:b])
        if parts:
            yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def short(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t[:8] for t in ids), np.uint64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text the keys of its runs of the first tier, and their first starts."""
    for ids, data, offsets in _texts(batches):
        for piece, ends, at in pieces(data, offsets):
            found, _ = bucketed(piece, ends)
            doc = np.searchsorted(ends, found.low, "right") - 1
            by = np.argsort(doc, kind="stable")
            keys, first = found.key[by], (found.low - ends[doc] + at)[by].astype(np.uint32)  # an Arrow string holds less than 2**32 bytes
            cuts = np.searchsorted(doc[by], np.arange(len(ids) + 1)).tolist()
            some = [i for i in range(len(ids)) if cuts[i] < cuts[i + 1]]
            cells = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary())  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(short(ids).view(np.int64)[some]), cells(keys), cells(first)], names=["id", "keys", "firsts"])


COUNTED = "key long, low long, high long, n long"


def _counted(key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """For each key the least and the greatest of its places and their number, so that a common passage leaves a batch as one row for each string."""
    key, place = key.view(np.int64), place.view(np.int64)
    by = np.lexsort((place, key))
    key, place = key[by], place[by]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    ends = np.append(cuts[1:], len(key))[: len(cuts)]
    return pa.RecordBatch.from_arrays([pa.array(key[cuts]), pa.array(place[cuts]), pa.array(place[ends - 1]), pa.array(ends - cuts)], names=["key", "low", "high", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and counted places of what ``_held`` gives."""
    for batch in batches:
        data, offsets = binary_of(batch.column(1))
        who = np.repeat(batch.column(0).to_numpy().view(np.uint64), np.diff(offsets) // 8)
        yield _counted(data.view(np.uint64), mix(who + binary_of(batch.column(2))[0].view(np.uint32)))


def _holders(bits):
    """The ids of texts with a key in the bitmap, of what ``_held`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_of(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
            some = np.unique(row[in_bitmap(bits.value, data.view(np.uint64))])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[some])], names=["id"])

    return run


def _keys(hots: list, wanted):
    """Keys and counted places of all runs of the tier after the hot ones; of the texts in the bitmap ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _texts(batches, wanted):
            for piece, ends, at in pieces(data, offsets):
                found = refined(*bucketed(piece, ends), hots, len(hots))
                doc = np.searchsorted(ends, found.low, "right") - 1
                yield _counted(found.key, mix(short(ids)[doc] + (found.low - ends[doc] + at).astype(np.uint64)))

    return run


CONTEXT = "key long, half long, text_id binary, first long, last long, bytes binary"


def _contexts(lives: list, hots: list, wanted):
    """Runs of starts with their bytes, of the texts in the bitmap ``wanted``; spans that are known to be repeats come without bytes, merged, under keys of their own. lives: for each tier what buckets hold several places; hots: which of them are split in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list] = {}  # strings of hot buckets that this task has sent on: bytes, text, place, whether known to be a repeat

        def rows(key, half, texts, first, last, data) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(half.view(np.int64)), pa.array(texts, pa.binary()), pa.array(first), pa.array(last), pa.array(data, pa.binary())], names=["key", "half", "text_id", "first", "last", "bytes"])

        for ids, data, offsets in _texts(batches, wanted):
            for piece, ends, at in pieces(data, offsets):
                every, prefix = bucketed(piece, ends)
                raw = piece.tobytes()
                sure: list[tuple[bytes, int, int]] = []
                for tier, live in enumerate(lives):
                    x = refined(every, prefix, hots, tier)
                    x = x[in_bitmap(live.value, x.key)]
                    if tier < len(hots):
                        x = x[~in_bitmap(hots[tier].value, x.key)]
                    if not len(x):
                        continue
                    doc = np.searchsorted(ends, x.low, "right") - 1
                    first, last = x.low - ends[doc] + at, x.high - ends[doc] + at
                    whole = span_hashes(prefix, x.low, x.high + DEPTH)
                    _, one, same = np.unique(whole, return_index=True, return_inverse=True)
                    bytes_of = lambda i: raw[x.low[i] : x.high[i] + DEPTH]  # noqa: E731, B023
                    # runs whose bytes have occurred in this piece: they and the first of them are repeats; one of them goes on
                    twin = np.array([one[same[i]] != i and bytes_of(i) == bytes_of(one[same[i]]) for i in range(len(x))])
                    known = twin.copy()
                    known[one[same[twin]]] = True
                    sure.extend((ids[d], a, b + DEPTH) for d, a, b in zip(doc[known].tolist(), first[known].tolist(), last[known].tolist(), strict=True))
                    some = np.flatnonzero(~twin).tolist()
                    if tier == len(STEPS) - 1:  # single strings: one of each leaves the task
                        new = []
                        for i in some:
                            string, d, f, h = bytes_of(i), ids[doc[i]], int(first[i]), int(whole[i])
                            if (seen := told.get(h)) and seen[0] == string:
                                sure.append((d, f, f + DEPTH))
                                if not seen[3]:
                                    sure.append((seen[1], seen[2], seen[2] + DEPTH))
                                    seen[3] = True
                            else:
                                told[h] = [string, d, f, False]
                                new.append(i)
                        some = new
                        if len(told) > 100_000:
                            told.clear()
                    if some:
                        yield rows(x.key[some], whole[some], [ids[d] for d in doc[some].tolist()], first[some], last[some], [bytes_of(i) for i in some])
                if sure:
                    spans = [(t, a, b) for t, mine in _by_text(sure).items() for a, b in merged(mine)]
                    first = np.array([a for _, a, _ in spans], np.int64)
                    own = mix(short([t for t, _, _ in spans]) + first.astype(np.uint64))
                    yield rows(own, own, [t for t, _, _ in spans], first, np.array([b - DEPTH for _, _, b in spans], np.int64), [None] * len(spans))

    return run


def _by_text(spans: list[tuple[bytes, int, int]]) -> dict[bytes, list[tuple[int, int]]]:
    out: dict[bytes, list[tuple[int, int]]] = {}
    for t, a, b in spans:
        out.setdefault(t, []).append((a, b))
    return out


def _sorted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_id, start, stop of repeats; rows come sorted by bucket, equal bytes together."""
    block: dict[tuple[bytes, int], bytes] = {}  # of whole buckets
    bucket: dict[tuple[bytes, int], bytes] = {}
    size = 0
    out: list[tuple[bytes, int, int]] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=["text_id", "start", "stop"])
        out.clear()
        return made

    def sort() -> None:
        nonlocal size
        places = list(block)
        for (t, first), starts in zip(places, repeated([block[p] for p in places]), strict=True):
            out.extend((t, first + a, first + b) for a, b in runs(starts))
        block.clear()
        size = 0

    now, last = None, None
    for rows in batches:
        for key, half, t, first, stop, data in zip(*(rows.column(k).to_pylist() for k in range(6)), strict=True):
            if data is None:
                out.append((t, first, stop + DEPTH))
                continue
            if key != now:
                if len(bucket) > 1:
                    block.update(bucket)
                    size += sum(map(len, bucket.values()))
                    if size >= BLOCK:
                        sort()
                bucket.clear()
                now, last = key, None
            if last and last[0] == half and last[1] == data:
                if (t, first) != last[2]:
                    out.append((t, first, stop + DEPTH))
                    if last[3]:
                        out.append((*last[2], last[2][1] + len(data)))
                        last[3] = False
            else:
                bucket[t, first] = data
                last = [half, data, (t, first), True]
        if len(out) > 50_000:
            yield batch()
    if len(bucket) > 1:
        block.update(bucket)
    if block:
        sort()
    yield batch()


def repeats(docs: DataFrame) -> DataFrame:
    """text_id, start, stop: byte spans of repeats in each text, texts by the MD5 of their bytes; spans may overlap."""
    sc = docs.sparkSession.sparkContext
    text = documents_of(docs).select("text")
    held = cut(text.mapInArrow(_held, "id long, keys binary, firsts binary"))

    def holders(bits):
        return sc.broadcast(bitmap_of(held, "id", _holders(bits)))

    lives, hots, splitting = [], [], None
    for _ in STEPS:  # for each tier that has buckets to split a pass over the texts that hold one
        keys = text.mapInArrow(_keys(hots, splitting), COUNTED) if hots else held.mapInArrow(_unpacked, COUNTED)
        shared = cut(keys.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low != high").select("key", "n"))
        lives.append(sc.broadcast(bitmap_of(shared, "key")))
        crowded = shared.where(F.col("n") > HOT)
        more = len(lives) < len(STEPS) and not crowded.isEmpty()
        if more:
            hots = [*hots, sc.broadcast(bitmap_of(crowded, "key"))]
            splitting = splitting or holders(hots[0])
        drop_cut(shared)
        if not more:
            break
    repeating = holders(lives[0])
    drop_cut(held)
    found = text.mapInArrow(_contexts(lives, hots, repeating), CONTEXT).repartition("key").sortWithinPartitions("key", "half")
    return found.mapInArrow(_sorted_blocks, "text_id binary, start long, stop long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, has_repeats of every document."""
    sc = docs.sparkSession.sparkContext
    text = documents_of(docs)

    def described(batches):
        for batch, data, offsets in slices(batches, "text"):
            each = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_id(x) for x in each], pa.binary()), pa.array([len(x) for x in each], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string())], names=["doc_id", "text_id", "n_bytes", "sha"])

    rows = cut(text.mapInArrow(described, "doc_id long, text_id binary, n_bytes long, sha string"))
    copies = rows.where(F.col("n_bytes") >= DEPTH).groupBy("text_id").count().where("count > 1").select("text_id")
    spans = cut(repeats(docs).groupBy("text_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).join(copies, "text_id", "left_anti"))
    asked = sc.broadcast(bitmap_of(spans.select(F.xxhash64("text_id").alias("x")), "x"))

    def touched(batches):
        for batch in batches:
            known = in_bitmap(asked.value, batch.column(2).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(known)).select(["text", "text_id"])

    # the id again in Spark, so that only documents with repeats leave their task
    some = text.withColumn("text_id", F.unhex(F.md5(F.col("text").cast("binary")))).select("text", "text_id", F.xxhash64("text_id").alias("x")).mapInArrow(touched, "text string, text_id binary")

    def kept(batches):
        for batch in batches:
            result = []
            for t, i, found in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, h, at, gone = t.as_py().encode(), hashlib.sha256(), 0, merged([(s["start"], s["stop"]) for s in found])
                for a, b in gone:
                    h.update(data[at:a])
                    at = b
                h.update(data[at:])
                result.append((i, sum(b - a for a, b in gone), len(gone), h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in result], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["text_id", "n_removed", "n_spans", "kept"])

    cut_texts = some.join(spans, "text_id").select("text", "text_id", "spans").mapInArrow(kept, "text_id binary, n_removed long, n_spans long, kept string")
    empty = hashlib.sha256(b"").hexdigest()
    told = cut_texts.unionByName(copies.select("text_id", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept")))
    out = rows.join(told, "text_id", "left")
    removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"), (removed > 0).alias("has_repeats"))
