"""Best-fit packing: hierarchical residual packing of token pieces into sequences.

Each input partition tokenises its documents, cuts only documents longer than the sequence into whole-sequence pieces
(the first piece takes the remainder) and packs its pieces best-fit decreasing. Full and nearly full bins are final.
Underfull bins become items: groups of ``fan_in`` partitions pack them again, round after round up a tree, until one
group is left.

Bins of one fill are alike, so a group of the tree gets no bins but how many there are of each fill: at most ``size`` rows
from each of its ``fan_in`` members, whatever the input. Best fit on these counts gives stretches: of the items of a fill
the numbers from a to b come to bins in a row, at one offset. The stretches are composed from the root down to the
partitions, and each bin finds its place by (partition, fill) and its number there. No task and no group grows with the
table, not even where nothing fits with anything.

The tokens are those of the given vocabulary with the tokenizers library. Where the vocabulary splits texts as byte-level
vocabularies do, texts of common Latin characters are split the same way first, and the library's model is asked for the
ids of each word, which a bounded cache keeps. Texts whose blanks all stand between visible characters are cut before
each blank by Arrow, and of the parts of a slice of texts each different one is split into words once.

Null and empty texts give one piece that holds the end token alone. A very long text is many pieces; a task holds the
numbers of its pieces (some 60 bytes for each 1024 tokens) and the tokens of one text at a time. Rows that repeat a
doc_id are packed as rows of their own. Null doc_ids stay null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents_of, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, leaf long, bin long, offset long, fill long, number long"
#: Items of a member (its numbers start to stop of one fill) and where they come: bins of the group above from ``bin`` on, each at ``offset``; what these bins are filled to in the end, and their numbers among the bins of that fill.
STRETCHES = "node long, fill long, start long, stop long, up long, bin long, offset long, filled long, number long"


#: Characters of the texts that are split here.
VISIBLE = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0x250))]


def _split_pattern() -> tuple[re.Pattern, re.Pattern]:
    """The word split for characters up to U+024F and a pattern of texts that hold no other: same pieces as the vocabulary's own split there."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "S": []}
    for c in VISIBLE:
        kinds[k if (k := unicodedata.category(c)[0]) in "LN" else "S"].append(re.escape(c))
    letters, digits, signs = ("".join(kinds[k]) for k in "LNS")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[{signs}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"), re.compile(f"[ \t\n\r{letters}{digits}{signs}]*")


def _alone(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text of a slice whether no blank ends it or stands beside other white space."""
    blank = data == 32
    white = blank | (data == 9) | (data == 10) | (data == 13)
    pairs = np.flatnonzero((blank[:-1] & white[1:]) | (white[:-1] & blank[1:]))
    last = blank[np.maximum(offsets[1:], 1) - 1] if len(blank) else np.zeros(len(offsets) - 1, bool)
    return (np.diff(np.searchsorted(pairs, offsets)) == 0) & ~(last & (np.diff(offsets) > 0))


class Words(dict):
    """Words to ids, by the model of the vocabulary where they aren't known yet. signs: the vocabulary's signs of a character's bytes."""

    def __init__(self, model, signs: dict[int, str]):
        self.model, self.signs = model, signs

    def __missing__(self, word: str) -> bytes:
        ids = list(map(attrgetter("id"), self.model.tokenize(word.translate(self.signs))))
        self[word] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


class Tokens:
    """Text to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str, cached: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(vocabulary)
        self.cached = cached
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(vocabulary, encoding="utf-8") as f:
            rules = json.load(f)
        before = rules.get("pre_tokenizer") or {}
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = Words(self.whole.model, {ord(c): "".join(x for x, _ in signs.pre_tokenize_str(c)) for c in [*" \t\n\r", *VISIBLE]})
        ids = self.whole.get_vocab(with_added_tokens=False)
        self.led = np.zeros(max(ids.values(), default=0) + 1, bool)  # tokens that begin with a blank
        self.led[[i for x, i in ids.items() if x.startswith(self.words.signs[32])]] = True
        self.bytewise = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rules.get("normalizer") and all(c in ids for x in self.words.signs.values() for c in x)
        self.split, self.plain = _split_pattern()

    def ids(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def simple(self, text: str) -> bool:
        return bool(self.bytewise and self.plain.fullmatch(text) and not any(s in text for s in self.special))

    def by_words(self, text: str) -> bytes:
        out = b"".join(map(self.words.__getitem__, self.split.findall(text)))
        if len(self.words) > self.cached:
            self.words.clear()
        return out

    def __call__(self, text: str) -> bytes:
        return self.by_words(text) if self.simple(text) else self.ids(text)

    def many(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each text of a slice; their bytes and offsets are given, too."""
        cuttable = np.array([alone and self.simple(t) for alone, t in zip(_alone(data, offsets).tolist(), texts.to_pylist(), strict=True)], bool)
        parts = pc.split_pattern(texts.filter(pa.array(cuttable)), " ")
        places = parts.offsets.to_numpy().astype(np.int64)
        first = np.zeros(len(parts.values), bool)
        first[places[:-1]] = True
        heads = parts.values.filter(pa.array(first)).to_pylist()
        rest = parts.values.filter(pa.array(~first)).dictionary_encode()
        # each different part once, in one text: its ids begin with the one that holds its blank
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(rest.dictionary)], rest.dictionary), " ")[0].as_py()
        ids = np.frombuffer(self.by_words(f" {joined}" if joined else ""), "<u4")
        starts = np.flatnonzero(self.led[ids])
        sizes, part = np.diff(starts, append=len(ids)), rest.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[part]))
        ids = ids[np.repeat(starts[part] - ends[:-1], sizes[part]) + np.arange(ends[-1])]
        cuts = ends[places - np.arange(len(places))].tolist()
        found = (self.by_words(head) + ids[a:b].tobytes() for head, a, b in zip(heads, cuts[:-1], cuts[1:], strict=True))
        for t, c in zip(texts, cuttable.tolist(), strict=True):
            yield next(found) if c else self(t.as_py())


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and each bin's fill."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0  # bit r: a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.asarray(fills, np.int64)


def best_fit_counts(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Best-fit decreasing of alike items: counts by length. Stretches (length, first item, items, first bin, offset), and the bins as runs (first bin, bins, fill) in order."""
    stretches: list[tuple[int, int, int, int, int]] = []
    by_room: dict[int, list[tuple[int, int]]] = {}  # runs of bins: first, how many
    bins = 0
    for length in sorted(counts, reverse=True):
        left, item = counts[length], 0

        def place(first: int, many: int, room: int, each: int) -> None:
            nonlocal item
            for k in range(each):
                stretches.append((length, item, many, first, size - room + k * length))  # noqa: B023
                item += many
            by_room.setdefault(room - each * length, []).append((first, many))  # noqa: B023

        for room in sorted(r for r in by_room if r >= length):
            runs, each = by_room.pop(room), room // length
            while runs and left:
                first, many = runs.pop()
                whole = min(many, left // each)
                rest = left - whole * each if whole < many else 0  # fewer than ``each``: they share one bin
                if whole:
                    place(first, whole, room, each)
                if rest:
                    place(first + whole, 1, room, rest)
                left -= whole * each + rest
                if kept := many - whole - bool(rest):
                    runs.append((first + many - kept, kept))
            if runs:
                by_room.setdefault(room, []).extend(runs)
            if not left:
                break
        each = size // length
        for many, of in ((left // each, each), (1, left % each)):
            if many and of:
                place(bins, many, size, of)
                bins += many
    return stretches, sorted((first, many, size - room) for room, runs in by_room.items() for first, many in runs)


def _merged(fan_in: int, size: int):
    """Best fit over one group of the tree: node, fill, n of its members to STRETCHES."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "node"], ignore_index=True)
        members: dict[int, list[tuple[int, int]]] = {}
        for node, fill, n in zip(frame["node"].tolist(), frame["fill"].tolist(), frame["n"].tolist(), strict=True):
            members.setdefault(fill, []).append((node, n))
        stretches, runs = best_fit_counts({fill: sum(n for _, n in m) for fill, m in members.items()}, size)
        firsts = np.asarray([first for first, _, _ in runs], np.int64)
        numbers, seen = [], {}
        for _, many, fill in runs:  # bins of one fill are numbered in their order
            numbers.append(seen.get(fill, 0))
            seen[fill] = numbers[-1] + many
        ends = {fill: np.cumsum([n for _, n in m]) for fill, m in members.items()}
        out = []
        for fill, item, many, first, offset in stretches:
            at, owners, borders = 0, members[fill], ends[fill]
            while at < many:  # cut where the member or the bins' final fill changes
                m, r = int(np.searchsorted(borders, item + at, "right")), int(np.searchsorted(firsts, first + at, "right")) - 1
                node, n = owners[m]
                take = min(many - at, int(borders[m]) - item - at, runs[r][0] + runs[r][1] - first - at)
                start = item + at - (int(borders[m]) - n)
                out.append((node, fill, start, start + take, node // fan_in, first + at, offset, runs[r][2], numbers[r] + first + at - runs[r][0]))
                at += take
        return pd.DataFrame(out, columns=[c.split()[0] for c in STRETCHES.split(", ")])

    return run


def _packed(vocabulary: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tail = Tokens(vocabulary), np.asarray([end], "<u4").tobytes()
        docs, pieces, starts, lengths, sums = [], [], [], [], []
        for rows, data, offsets in slices(batches, "text", 1 << 23):
            for d, ids in zip(rows.column(0).to_pylist(), tokens.many(rows.column(1), data, offsets), strict=True):
                ids += tail
                n = len(ids) // 4
                at = 0
                for k in range(-(-n // size)):
                    to = min(n, at + (n - 1) % size + 1) if k == 0 else at + size
                    docs.append(d)
                    pieces.append(k)
                    starts.append(at)
                    lengths.append(to - at)
                    sums.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at = to
        bins, offsets, fills = best_fit(np.asarray(lengths, np.int64), size)
        leaf = np.full(len(docs), TaskContext.get().partitionId(), np.int64)
        order = np.argsort(fills, kind="stable")
        number = np.zeros(len(fills), np.int64)  # of a bin among those of its fill
        number[order] = np.arange(len(fills)) - np.searchsorted(fills[order], fills[order])
        table = pa.table({"doc_id": pa.array(docs, pa.int64()), "piece": pa.array(pieces, pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()), "leaf": leaf, "bin": bins, "offset": offsets, "fill": fills[bins], "number": number[bins]})
        yield from table.to_batches(max_chunksize=65536)

    return run


def _sequence(level: int, node: str, number: str) -> F.Column:
    """Numbers of sequences: the round that closed it, the group there, the bin there."""
    return F.expr(f"shiftleft(CAST({level} AS LONG), 57) + shiftleft({node}, 36) + {number}")


def pack(docs: DataFrame, vocabulary: str, end: int = 2, size: int = 1024, nearly: float = 0.985, fan_in: int = 16) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    ``nearly``: bins filled to this share are final; all others go up.
    """
    placed = cut(documents_of(docs).mapInArrow(_packed(vocabulary, end, size), PIECES))
    full = int(size * nearly)
    items = placed.where((F.col("offset") == 0) & (F.col("fill") < full)).groupBy(F.col("leaf").alias("node"), "fill").agg(F.count("*").alias("n"))
    top = placed.agg(F.max("leaf")).first()[0] or 0
    rounds: list[DataFrame] = []
    while not rounds or top:
        rounds.append(cut(items.groupBy(F.floor(F.col("node") / fan_in)).applyInPandas(_merged(fan_in, size), STRETCHES)))
        items = rounds[-1].where((F.col("offset") == 0) & (F.col("filled") < full)).groupBy(F.col("up").alias("node"), F.col("filled").alias("fill")).agg(F.sum(F.col("stop") - F.col("start")).alias("n"))
        top //= fan_in
    places = None  # node, fill, start, stop, sequence_id of the first, offset
    for level in range(len(rounds), 0, -1):
        step = rounds[level - 1]
        last = F.lit(places is None) | (F.col("filled") >= full)
        found = step.where(last).select("node", "fill", "start", "stop", _sequence(level, "up", "bin").alias("sequence_id"), "offset")
        if places is not None:
            above = places.select(F.col("node").alias("up"), F.col("fill").alias("filled"), F.col("start").alias("first"), F.col("stop").alias("end"), "sequence_id", F.col("offset").alias("by"))
            met = step.where(~last).join(above, ["up", "filled"]).withColumn("lo", F.greatest("number", "first")).withColumn("hi", F.least(F.expr("number + stop - start"), F.col("end"))).where("lo < hi")
            found = found.unionByName(met.selectExpr("node", "fill", "start + lo - number AS start", "start + hi - number AS stop", "sequence_id + lo - first AS sequence_id", "offset + by AS offset"))
        places = cut(found)
    held = places.groupBy(F.col("node").alias("leaf"), "fill").agg(F.collect_list(F.struct("start", "stop", "sequence_id", F.col("offset").alias("by"))).alias("stretches"))
    mine = F.filter("stretches", lambda x: (F.col("number") >= x["start"]) & (F.col("number") < x["stop"]))[0]
    rows = placed.join(held, ["leaf", "fill"], "left").withColumn("mine", mine)
    moved = F.col("mine.sequence_id") + F.col("number") - F.col("mine.start")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce(moved, _sequence(0, "leaf", "bin")).alias("sequence_id"), (F.col("offset") + F.coalesce("mine.by", F.lit(0))).alias("offset"))
