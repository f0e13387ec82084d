"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct word shingles as 64-bit hashes; documents with equal sets are one set, named by its
smallest doc_id. A set of more than ``PART`` shingles is cut by hash into parts of about 128 to 256; if two sets reach
the threshold, some part of them does (the whole ratio is a mean of the parts' ratios), and there the two share one of
the first ``m - ceil(0.8 m) + 1`` shingles in any order common to all. The order here puts shingles that a count sketch
of the whole corpus finds frequent last, so boilerplate makes no large buckets. Shingles of a part are hashed into
``GROUPS`` groups; the counts per group are its point. Summed minima of two points bound the overlap.

* Near sets: the parts that share such a key meet as points in an R-tree, whose nodes' upper corners and then the points
  themselves prune what can't reach the threshold. What is left connects *near* sets; a bucket gives a spanning forest
  of them, never pairs. The first ``FIRST`` keys come first; all others follow only where different groups of near sets
  meet. Every link lies within a group of near sets.
* Links: the sets of each group meet once, whole, in an R-tree with finer points; pairs that survive and aren't linked
  already are verified on all bits. A group gives a spanning forest of its links.

Buckets of more than ``LARGE`` parts and groups of more than ``BLOCK`` sets (or ``BLOCK_SHINGLES`` shingles) are split by
hash. What the splits leave apart is compared in a second pass, in which all but the commonest component of a bucket or
group visit every split; only where thousands of sets are near each other without being linked does this grow with the
square of their number, in blocks of bounded memory. Components are exact. What is broadcast (a sketch, bitmaps) has a
fixed size whatever the input.

Null texts are empty; sets without shingles link with nothing; rows with a null doc_id get a null component and link
with nothing; rows that repeat a doc_id are one node, with the shingles of each row's own text. Very long texts are sets
of many parts. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bitmap_of, cut, documents_of, drop_cut, in_bitmap, mix, ngrams, prefix_sums, slices, span_hashes, words
from .components import components, joined

GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
GROUPS = 128
PART = 256
FIRST = 5
LARGE = 8192
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000
LEAF = 16
SKETCH = 18  # 2**SKETCH counters


def least_overlap(total: np.ndarray | int, percent: int):
    """The smallest intersection of two sets of so many shingles together that reaches the threshold."""
    return -(-percent * total // (100 + percent))


def shingle_sets(rows: int, data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    data = LOWER[data]
    starts, ends, first = words(data, offsets, GAP)
    h = span_hashes(prefix_sums(data), starts, ends)
    grams = ngrams(h, n)
    out = []
    for i in range(rows):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngrams(h[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    one = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    two = mix(s * np.uint64(0x2545F4914F6CDD1D) + np.uint64(9)).sum(dtype=np.uint64)
    return tuple(mix(np.array([one, two], np.uint64)).view(np.int64).tolist())


class Order:
    """Keys in the common order: frequent shingles, by the sketch, last."""

    def __init__(self, counts: np.ndarray):
        ratio = counts / max(1.0, 2 * counts.mean())
        self.level = np.clip(np.ceil(np.log2(np.maximum(ratio, 1))), 0, 7).astype(np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        return (self.level[s >> np.uint64(64 - SKETCH)] << np.uint64(60)) | (s >> np.uint64(4))


def cuts_of(n: int, percent: int) -> list[int]:
    """Numbers of parts (powers of two) at which a set of n shingles meets others: by its own size and by the largest that can link with it."""
    by = lambda size: max(0, (size - 1) // PART).bit_length()
    return [1 << k for k in range(by(n), by(100 * n // percent) + 1)]


def counted(x: np.ndarray, groups: int) -> np.ndarray:
    """Counts per group, at most 255 (which then bounds nothing)."""
    return np.minimum(np.bincount((x >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups), 255).astype(np.uint8)


def parts_of(s: np.ndarray, order: Order, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each part of a set: the number of parts, its size, its keys in order, its point."""
    k = order.keys(s)
    for level in cuts_of(len(s), percent):
        part = (s & np.uint64(level - 1)).astype(np.int64)
        at = np.lexsort((k, part)) if level > 1 else np.argsort(k)
        keys = mix(k[at] ^ np.uint64(0x9E3779B97F4A7C15 * level & (1 << 64) - 1))
        low = 0
        for size in np.bincount(part, minlength=level).tolist():
            if size:
                mine = at[low : low + size]
                yield level, size, keys[low : low + size - -(-percent * size // 100) + 1], counted(s[mine], GROUPS)
                low += size


def bounds(rows: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Summed minima of points (or upper corners) and a point, or of points pair by pair."""
    least = np.minimum(rows, p)
    out = least.sum(1, dtype=np.int64)
    full = (least == 255).any(1)
    out[full] = 1 << 40
    return out


class Tree:
    """An R-tree packed in order of size: upper corners of leaves of LEAF points and of nodes of LEAF leaves."""

    def __init__(self, p: np.ndarray, n: np.ndarray):
        self.p, self.n = p, n
        cuts = np.arange(0, len(n), LEAF)
        self.leaf, self.low = np.maximum.reduceat(p, cuts), n[cuts]
        self.node = np.maximum.reduceat(self.leaf, np.arange(0, len(cuts), LEAF))

    def candidates(self, i: int, percent: int, apart: np.ndarray | None = None) -> np.ndarray:
        """Points after i (in order of size) whose overlap with it may reach the threshold; of those that ``apart`` marks."""
        p, n = self.p[i], int(self.n[i])
        end = int(np.searchsorted(self.n, 100 * n // percent, "right"))
        wanted = np.arange(i + 1, end)
        if apart is not None:
            wanted = wanted[apart[i + 1 : end]]
        if not len(wanted):
            return wanted
        leaves = np.unique(wanted // LEAF)
        nodes = np.unique(leaves // LEAF)
        ok = bounds(self.node[nodes], p) >= least_overlap(2 * n, percent)
        leaves = leaves[np.isin(leaves // LEAF, nodes[ok])]
        leaves = leaves[bounds(self.leaf[leaves], p) >= least_overlap(n + np.maximum(self.low[leaves], n), percent)]
        kept = np.zeros(end // LEAF + 1, bool)
        kept[leaves] = True
        wanted = wanted[kept[wanted // LEAF]]
        return wanted[bounds(self.p[wanted], p) >= least_overlap(n + self.n[wanted], percent)]


def near(bucket: np.ndarray, comp: np.ndarray, n: np.ndarray, m: np.ndarray, place: np.ndarray, point: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (of component names) of what may reach the threshold within runs of equal ``bucket``. n: sizes of the sets, m: of the parts that meet, place: of the key in the part."""
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    length = np.diff(np.append(cuts, len(bucket)))
    names, c = np.unique(comp, return_inverse=True)

    def may(i, j):
        wanted = least_overlap(m[i] + m[j], percent)
        most = np.minimum(m[i] - place[i], m[j] - place[j]) + np.minimum(place[i], place[j])
        return (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (most >= wanted), wanted

    left, right = [], []
    small = np.repeat(length <= LEAF, length)
    for d in range(1, min(LEAF, int(length.max(initial=1)))):  # one leaf: all of it against each other, all such buckets at once
        i = np.flatnonzero(small[:-d] & (bucket[d:] == bucket[:-d]))
        ok, wanted = may(i, i + d)
        i, wanted = i[ok], wanted[ok]
        for at in range(0, len(i), 1 << 16):
            x = i[at : at + (1 << 16)]
            x = x[bounds(point[x], point[x + d]) >= wanted[at : at + (1 << 16)]]
            left.append(c[x])
            right.append(c[x + d])
    for at, k in zip(cuts[length > LEAF], length[length > LEAF], strict=True):
        own, root = np.unique(c[at : at + k], return_inverse=True)
        if len(own) == 1:
            continue
        by = np.argsort(m[at : at + k], kind="stable")
        tree, root, first = Tree(point[at : at + k][by], m[at : at + k][by]), root[by], at + by
        for i in range(k - 1):
            js = tree.candidates(i, percent, root != root[i])
            js = js[may(first[i], first[js])[0]]
            if len(js):
                gone = np.unique(root[js])
                left.append(np.full(len(gone), c[first[i]]))
                right.append(np.array([c[first[j]] for j in js[np.unique(root[js], return_index=True)[1]]]))
                root[np.isin(root, gone)] = root[i]
                if (root == root[0]).all():
                    break
    if not left:
        return names[:0], names[:0]
    lab = joined(np.concatenate(left), np.concatenate(right), len(names))
    moved = np.flatnonzero(lab != np.arange(len(names)))
    return names[lab[moved]], names[moved]


def linked(s: list[np.ndarray], percent: int, root: np.ndarray | None = None, guest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets (sorted 64-bit shingles). ``root``: components known before; ``guest``: pairs without one of these are decided."""
    size = np.array([len(x) for x in s])
    order = np.argsort(size, kind="stable")
    s, size = [s[i] for i in order], size[order]
    root = np.arange(len(s)) if root is None else np.unique(root, return_inverse=True)[1][order]
    guest = None if guest is None else guest[order]
    groups = min(512, max(64, 1 << int(np.median(size) // 2).bit_length()))
    tree = Tree(np.stack([counted(x, groups) for x in s]), size)
    tokens, ids = np.unique(np.concatenate(s), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    mine, out = np.zeros(len(tokens), np.int32), []
    for i in range(len(s) - 1):
        apart = root != root[i]
        if guest is not None and not guest[i]:
            apart &= guest
        at = tree.candidates(i, percent, apart)
        if not len(at):
            continue
        mine[ids[starts[i] : ends[i]]] = 1
        if 3 * len(at) > at[-1] - at[0]:  # nearly all in a row: one gather
            shared = np.add.reduceat(mine[ids[starts[at[0]] : ends[at[-1]]]], starts[at[0] : at[-1] + 1] - starts[at[0]])[at - at[0]]
        else:
            shared = np.array([mine[ids[starts[j] : ends[j]]].sum() for j in at])
        mine[ids[starts[i] : ends[i]]] = 0
        at = at[shared >= least_overlap(size[i] + size[at], percent)]
        gone, which = np.unique(root[at], return_index=True)
        out.extend((int(order[i]), int(order[j])) for j in at[which])
        if len(gone):
            root[np.isin(root, gone)] = root[i]
    return out


def binary_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its n+1 offsets from 0."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def points_column(p: np.ndarray) -> pa.Array:
    offsets = np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(p), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(p))])


PLACED = "key long, split int, home long, n long, m int, place int, comp long, point binary"


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters; a part of them at a time, streamed."""

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

    kind = "part int, counts binary"
    found = rows.where("part is not null").select("part", "counts").mapInArrow(added, kind).repartition("part").mapInArrow(added, kind).orderBy("part").collect()  # 64 parts of a fixed size
    return np.concatenate([np.frombuffer(r.counts, np.int64) for r in found]) if found else np.zeros(1 << SKETCH)


def cluster(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sc = docs.sparkSession.sparkContext
    text = documents_of(docs)

    def described(batches):
        """A row for each document, and at last the task's counters of shingles."""
        names = ["doc_id", "n", "set", "set2", "part", "counts"]
        counts = np.zeros(1 << SKETCH, np.int64)
        for batch, data, offsets in slices(batches, "text"):
            sets = shingle_sets(batch.num_rows, data, offsets, n)
            ids = [set_ids(s) if len(s) else (0, 0) for s in sets]
            slot = (np.concatenate(sets) >> np.uint64(64 - SKETCH)).astype(np.int64)
            counts += np.bincount(slot, minlength=1 << SKETCH)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if counts.any():
            none = pa.nulls(64, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in counts.reshape(64, -1)], pa.binary())], names=names)

    first_pass = cut(text.mapInArrow(described, "doc_id long, n long, set long, set2 long, part int, counts binary"))
    rows = first_pass.where("part is null").drop("part", "counts")
    order = sc.broadcast(Order(_sketch(first_pass)))
    named = rows.where("doc_id is not null and n > 0")
    homes = cut(named.groupBy("set", "set2", "n").agg(F.min("doc_id").alias("home")))
    is_home = sc.broadcast(bitmap_of(homes, "home"))
    known = text.where("doc_id is not null")

    def held_by(bits):
        """Only documents whose doc_id the bitmap has."""

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(bits.value, batch.column(0).to_numpy().view(np.uint64))))

        return run

    def pointed(batches):
        """A row for each part of each set."""
        kinds = pa.schema([("home", pa.int64()), ("set", pa.int64()), ("set2", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("point", pa.binary())])
        seen: set[tuple] = set()
        held, size = [], 0
        for batch, data, offsets in slices(held_by(is_home)(batches), "text"):
            for home, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.num_rows, data, offsets, n), strict=True):
                ids = set_ids(s) if len(s) else None
                if ids is None or (home, *ids) in seen:
                    continue
                seen.add((home, *ids))
                for level, m, keys, point in parts_of(s, order.value, percent):
                    held.append((home, *ids, len(s), level, m, keys.tobytes(), point.tobytes()))
                    size += len(keys) * 8 + GROUPS
            if len(seen) > 100_000:  # repeated rows stand close together or cost a row more
                seen.clear()
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)

    same_set = ["home", "set", "set2", "n"]
    parts = cut(known.mapInArrow(pointed, "home long, set long, set2 long, n long, level int, m int, keys binary, point binary").join(homes.select(*same_set), same_set, "left_semi").drop("set", "set2"))

    def keyed(bits, column):
        """(key, the column) for all keys, or those in the bitmap."""

        def run(batches):
            for batch in batches:
                data, offsets = binary_of(batch.column(0))
                keys, who = data.view(np.uint64), np.repeat(batch.column(1).to_numpy(), np.diff(offsets) // 8)
                if bits is not None:
                    ok = in_bitmap(bits.value, keys)
                    keys, who = keys[ok], who[ok]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(who)], names=["key", column])

        return run

    def shared_by_two(df: DataFrame, column: str, bits=None) -> DataFrame:
        pairs = df.select("keys", column).mapInArrow(keyed(bits, column), f"key long, {column} long")
        return pairs.groupBy("key").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("times")).where("low != high").select("key", "times")

    shared = cut(shared_by_two(parts, "home"))
    live = sc.broadcast(bitmap_of(shared, "key"))
    most = shared.agg(F.max("times")).first()[0] or 0
    large = sc.broadcast(bitmap_of(shared.where(F.col("times") > LARGE), "key")) if most > LARGE else None
    splits = -(-2 * most // LARGE)

    def dealt(only, hot, first):
        """The parts under their keys in bitmap ``only``; the first ``first`` keys of a set, or all. Keys in ``hot`` alone (with the split still to come), or all others. first: large keys split by hash."""

        def run(batches):
            for batch in batches:
                data, offsets = binary_of(batch.column(batch.schema.names.index("keys")))
                column = lambda c: batch.column(batch.schema.names.index(c)).to_numpy()  # noqa: E731, B023
                keys, length = data.view(np.uint64), np.diff(offsets) // 8
                row = np.repeat(np.arange(batch.num_rows), length)
                place = np.arange(len(keys)) - np.repeat(offsets[:-1] // 8, length)
                ok = in_bitmap(only.value, keys)
                if first:
                    ok &= place < np.repeat(-(-first // column("level")), length)
                if hot:
                    bits, wanted = hot
                    ok &= in_bitmap(bits.value, keys) == wanted
                keys, row, place = keys[ok], row[ok], place[ok]
                split = np.zeros(len(keys), np.int32)
                if first and large:
                    home = column("home").astype(np.uint64)[row]
                    split = np.where(in_bitmap(large.value, keys), mix(home * np.uint64(0x9E3779B97F4A7C15) ^ keys) % np.uint64(splits), np.uint64(0)).astype(np.int32)
                points = binary_of(batch.column(batch.schema.names.index("point")))[0].reshape(-1, GROUPS)
                for at in range(0, len(keys), 1 << 15):
                    r = row[at : at + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 15)].view(np.int64)), pa.array(split[at : at + (1 << 15)]), *(pa.array(column(c)[r]) for c in ("home", "n", "m")), pa.array(place[at : at + (1 << 15)].astype(np.int32)), pa.array(column("comp")[r]), points_column(points[r])], names=["key", "split", "home", "n", "m", "place", "comp", "point"])

        return run

    def near_ones(batches):
        """Spanning forests of buckets; a bucket on the border of two batches waits for the next."""

        def found(chunk):
            key, split, _, size, m, place, comp = (chunk.column(k).to_numpy() for k in range(7))
            bucket = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (split[1:] != split[:-1])))
            points = binary_of(chunk.column(7))[0].reshape(-1, GROUPS)
            a, b = near(bucket, comp, size, m.astype(np.int64), place.astype(np.int64), points, percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) < 1 << 15:
                continue
            chunk = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            key, split = chunk.column(0).to_numpy(), chunk.column(1).to_numpy()
            last = int(np.flatnonzero((key != key[-1]) | (split != split[-1])).max(initial=-1)) + 1
            if last:
                yield found(chunk.slice(0, last))
            held = [chunk.slice(last)]
        if held:
            yield found(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def forest(placed: DataFrame) -> DataFrame:
        return placed.repartition("key", "split").sortWithinPartitions("key", "split").mapInArrow(near_ones, "a long, b long").distinct()

    alone = parts.withColumn("comp", F.col("home"))
    edges = cut(forest(alone.mapInArrow(dealt(live, None, FIRST), PLACED)))
    comps = components(edges)
    placed = cut(parts.join(comps.select(F.col("node").alias("home"), F.col("component").alias("comp")), "home", "left").withColumn("comp", F.coalesce("comp", "home")))
    drop_cut(parts)
    apart = cut(shared_by_two(placed, "comp", live))
    mixed = sc.broadcast(bitmap_of(apart, "key"))
    hot_keys = apart.where(F.col("times") > LARGE)
    if hot_keys.isEmpty():
        more = placed.mapInArrow(dealt(mixed, None, 0), PLACED)
    else:
        hot = sc.broadcast(bitmap_of(hot_keys, "key"))
        more = placed.mapInArrow(dealt(mixed, (hot, False), 0), PLACED)
        visiting = placed.mapInArrow(dealt(mixed, (hot, True), 0), PLACED)
        major = visiting.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.ceil(2 * F.sum("count") / LARGE).cast("int").alias("splits"))
        spread = F.when(F.col("comp") == F.col("major"), F.array(F.pmod(F.xxhash64("home", "key"), F.col("splits")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("splits") - 1))
        visiting = visiting.join(major, "key").withColumn("split", F.explode(spread)).select(*more.columns)
        more = more.unionByName(visiting)
    edges2 = cut(edges.unionByName(forest(more)))
    drop_cut(placed)
    members = cut(components(edges2).toDF("home", "comp").join(homes.groupBy("home").agg(F.max("n").alias("n")), "home"))

    # the sets of a group of near ones meet
    def met(batches):
        """Links among the sets of each (comp, block); memory: one block."""
        held: list[tuple] = []
        last, out = None, []

        def found():
            home = np.array([x[0] for x in held])
            root, guest = (np.array([x[k] for x in held]) for k in (2, 3))
            if len(np.unique(root)) > 1:
                out.extend((int(home[i]), int(home[j])) for i, j in linked([x[1] for x in held], percent, root, guest if guest.any() else None))

        for batch, data, offsets in slices(batches, "text"):
            who = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4)]
            for comp, block, home, root, guest, s in zip(*who, shingle_sets(batch.num_rows, data, offsets, n), strict=True):
                if (comp, block) != last:
                    if held:
                        found()
                    held, last = [], (comp, block)
                if len(s):
                    held.append((home, s, root, guest))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])
                out.clear()
        if held:
            found()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    def links_of(dealt_out: DataFrame, bits) -> DataFrame:
        """dealt_out: home, comp, block, root, guest."""
        texts = known.mapInArrow(held_by(bits), "doc_id long, text string").withColumnRenamed("doc_id", "home")
        meeting = texts.join(dealt_out, "home").select("comp", "block", "home", "root", "guest", "text")
        return cut(meeting.repartition("comp", "block").sortWithinPartitions("comp", "block").mapInArrow(met, "a long, b long").where("a != b").distinct())

    blocks = cut(members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    hashed = lambda seed: F.pmod(F.xxhash64("home", F.lit(seed)), F.col("blocks")).cast("int")
    own = members.join(blocks, "comp")
    twice = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array(hashed(0), hashed(1) + F.col("blocks")))
    links = links_of(own.select("home", "comp", F.explode(twice).alias("block"), F.col("home").alias("root"), F.lit(False).alias("guest")), sc.broadcast(bitmap_of(members, "home")))
    exact = components(links)
    split = blocks.where("blocks > 1")
    again = []
    if not split.isEmpty():
        rooted = cut(members.join(split, "comp").join(exact.toDF("home", "root"), "home", "left").withColumn("root", F.coalesce("root", "home")))
        major = rooted.groupBy("comp", "root").count().groupBy("comp").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        rooted = rooted.join(major, "comp")
        stay = rooted.select("home", "comp", hashed(0).alias("block"), "root", F.lit(False).alias("guest"))
        visit = rooted.where("root != major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != hashed(0)).select("home", "comp", "block", "root", F.lit(True).alias("guest"))
        again.append(links_of(stay.unionByName(visit), sc.broadcast(bitmap_of(rooted, "home"))))

    # documents that hold several texts join their sets
    several = named.groupBy("doc_id").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low != high").select("doc_id")
    if not several.isEmpty():
        again.append(named.join(several, "doc_id").join(homes, ["set", "set2", "n"]).select(F.col("doc_id").alias("a"), F.col("home").alias("b")))
    for more_links in again:
        exact = components(exact.toDF("a", "b").unionByName(more_links))
    drop_cut(shared)
    drop_cut(apart)
    out = rows.join(homes, ["set", "set2", "n"], "left").join(exact.toDF("home", "component"), "home", "left")
    name = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "home", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"))
