"""MinHash near-duplicates with an LSH forest.

A document's set is its distinct word shingles as 64-bit hashes; documents with equal sets are one set, named by its
smallest doc_id. A set's signature holds the minima of ``TREES * DEPTH`` hash functions. Each tree of the forest is one
order of the signatures, by its own DEPTH minima; a region of a tree is a run of signatures with a common prefix. A set
looks at the shallowest region, from a prefix of ``SHALLOW`` on, that holds at most ``REGION`` sets, or at the deepest: the
depth adapts to how dense the forest is there. Sets with 0.8 of their shingles in common share a prefix of DEPTH minima in
one of the trees but for a part (1 - 0.8**4)**32 = 5e-8 of them, in sparse regions (0.64**2 a tree) all but 1e-14.

* Near sets: within a region, signatures that agree in at least ``AGREE`` of their places (fewer happens to a linked pair
  with a probability under 1e-8) and whose sizes allow the threshold. A region gives a spanning forest of its near sets,
  never pairs. The first ``FIRST`` trees come first; of all trees only regions follow in which different groups of near
  sets still meet. Deepest regions of more than REGION sets are split by hash, and in the second pass all but the commonest
  group of such a region visit each split, so a split leaves nothing apart.
* Links: the sets of a group of near sets meet once, whole, and are verified on full sets; a group gives a spanning forest
  of its links. Groups of more than ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles meet in blocks by hash, then all but the
  commonest component of the group visit every block.

Components of the links are exact for the candidates. Signatures travel as 16 bits a minimum, and only with regions that
hold two sets or more; bitmaps that say which have a fixed size whatever the input. Many thousands of sets that are near
each other without being linked cost work that grows with the square of their number, in blocks of bounded memory.

Null texts are empty; sets without shingles link with nothing; rows with a null doc_id get a null component, link with
nothing and are kept; rows that repeat a doc_id are one node, with the shingles of each row's own text. Texts are read
whole, however long. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, cut, documents_of, drop_cut, in_bitmap, mix, slices
from .components import components, joined
from .jaccard import binary_of, linked, set_ids, shingle_sets

TREES, DEPTH, SHALLOW = 32, 4, 2
FIRST = 6
REGION = 2048
AGREE = 70  # of TREES * DEPTH
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000

_rng = np.random.default_rng(13)
TURN = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)
TIMES = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of the hash functions over a set, as 32 bits each."""
    least = np.full(len(TURN), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1024):
        np.minimum(least, ((s[at : at + 1024, None] ^ TURN) * TIMES).min(0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def region_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """A key for each row of signatures and each tree: the tree, and its first ``depth`` minima."""
    trees = sig.reshape(len(sig), TREES, DEPTH).astype(np.uint64)
    key = np.broadcast_to(np.arange(TREES, dtype=np.uint64) * np.uint64(DEPTH + 1) + np.uint64(depth), trees.shape[:2])
    for d in range(depth):
        key = mix(key ^ trees[:, :, d]) * np.uint64(0x9E3779B97F4A7C15)
    return key


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def near(bucket: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (of component names) of near signatures within runs of equal ``bucket``."""
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    length = np.diff(np.append(cuts, len(bucket)))
    names, c = np.unique(comp, return_inverse=True)

    def may(i, j):
        return (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))

    left, right = [], []
    small = np.repeat(length <= 16, length)
    for d in range(1, min(16, int(length.max(initial=1)))):  # all small regions at once
        i = np.flatnonzero(small[:-d] & (bucket[d:] == bucket[:-d]))
        i = i[may(i, i + d)]
        i = i[agreement(sig[i], sig[i + d]) >= AGREE]
        left.append(c[i])
        right.append(c[i + d])
    for at, k in zip(cuts[length > 16], length[length > 16], strict=True):
        own, root = np.unique(c[at : at + k], return_inverse=True)
        for i in range(k - 1):
            if (root == root[0]).all():
                break
            js = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            js = js[may(at + i, at + js)]
            js = js[agreement(sig[at + js], sig[at + i]) >= AGREE]
            gone, first = np.unique(root[js], return_index=True)
            if len(gone):
                left.append(np.full(len(gone), c[at + i]))
                right.append(c[at + js[first]])
                root[np.isin(root, gone)] = root[i]
    if not left:
        return names[:0], names[:0]
    lab = joined(np.concatenate(left), np.concatenate(right), len(names))
    moved = np.flatnonzero(lab != np.arange(len(names)))
    return names[lab[moved]], names[moved]


def _held_by(bits):
    """Only rows whose first column the bitmap has."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    return run


def _whole(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows with whole runs of (first, second column)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < most:
            continue
        chunk = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, split = chunk.column(0).to_numpy(), chunk.column(1).to_numpy()
        last = int(np.flatnonzero((key != key[-1]) | (split != split[-1])).max(initial=-1)) + 1
        if last:
            yield chunk.slice(0, last)
        held = [chunk.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _described(n: int):
    def run(batches):
        for batch, data, offsets in slices(batches, "text"):
            sets = shingle_sets(batch.num_rows, data, offsets, n)
            ids = [set_ids(s) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64())], names=["doc_id", "n", "set", "set2"])

    return run


def _signed(bits, n: int):
    """The signatures of the sets that name others or themselves."""

    def run(batches):
        for batch, data, offsets in slices(_held_by(bits)(batches), "text"):
            sets = shingle_sets(batch.num_rows, data, offsets, n)
            some = [i for i, s in enumerate(sets) if len(s)]
            ids = [set_ids(sets[i]) for i in some]
            rows = [batch.column(0).take(pa.array(some, pa.int64())), *(pa.array([x[k] for x in ids], pa.int64()) for k in (0, 1)), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([signature(sets[i]).tobytes() for i in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["home", "set", "set2", "n", "sig"])

    return run


def _signatures(column: pa.Array) -> np.ndarray:
    return binary_of(column)[0].view(np.uint32).reshape(-1, TREES * DEPTH)


class Depths:
    """For each depth the regions that are too large for it; bitmaps."""

    def __init__(self):
        self.crowded: list = []  # broadcast bitmaps for SHALLOW, SHALLOW + 1, ...

    def keys(self, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of the region that each set looks at in each tree, and whether it is one of the last depth looked at."""
        key, last = region_keys(sig, SHALLOW), np.ones((len(sig), TREES), bool)
        for k, bits in enumerate(self.crowded):
            last &= in_bitmap(bits.value, key.ravel()).reshape(key.shape)
            key = np.where(last, region_keys(sig, SHALLOW + k + 1), key)
        return key, last


def _keyed(depths: Depths, column: str, only_last: bool, bits=None):
    """(key, the column) of each set (or group) and tree."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                key, last = depths.keys(_signatures(part.column(1)))
                who = np.repeat(part.column(0).to_numpy(), TREES)
                ok = last.ravel() if only_last else np.ones(len(who), bool)
                if bits is not None:
                    ok &= in_bitmap(bits.value, key.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[ok].view(np.int64)), pa.array(who[ok])], names=["key", column])

    return run


def _shared(df: DataFrame, column: str, depths: Depths, only_last: bool = False, bits=None) -> DataFrame:
    """The regions in which different values of the column meet, and their rows."""
    pairs = df.select(column, "sig").mapInArrow(_keyed(depths, column, only_last, bits), f"key long, {column} long")
    return pairs.groupBy("key").agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("times")).where("low != high").select("key", "times")


PLACED = "key long, split int, home long, n long, comp long, sig binary"


def _dealt(depths: Depths, live, trees: int, large=None, splits: int = 1, only_large: bool | None = None):
    """The sets under their regions in ``live``. large: bitmap of regions that are split by hash; with ``only_large``, only these (unsplit) or only the others."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                home, n, comp = (part.column(k).to_numpy() for k in range(3))
                sig = _signatures(part.column(3))
                key = depths.keys(sig)[0][:, :trees]
                ok = in_bitmap(live.value, key.ravel()).reshape(key.shape)
                hot = in_bitmap(large.value, key.ravel()).reshape(key.shape) if large else np.zeros(key.shape, bool)
                if only_large is not None:
                    ok &= hot == only_large
                row, tree = np.nonzero(ok)
                key, hot = key[row, tree], hot[row, tree]
                split = np.zeros(len(row), np.int32)
                if only_large is None and large:
                    split = np.where(hot, mix(home[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ key) % np.uint64(splits), np.uint64(0)).astype(np.int32)
                short = np.ascontiguousarray((sig & np.uint32(0xFFFF)).astype(np.uint16))
                for at in range(0, len(row), 1 << 14):
                    r = row[at : at + (1 << 14)]
                    ends = np.arange(len(r) + 1, dtype=np.int32) * (2 * TREES * DEPTH)
                    cells = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(short[r]))])
                    yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 14)].view(np.int64)), pa.array(split[at : at + (1 << 14)]), pa.array(home[r]), pa.array(n[r]), pa.array(comp[r]), cells], names=["key", "split", "home", "n", "comp", "sig"])

    return run


def _near_ones(percent: int):
    def run(batches):
        for chunk in _whole(batches):
            key, split, _, n, comp = (chunk.column(k).to_numpy() for k in range(5))
            bucket = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (split[1:] != split[:-1])))
            a, b = near(bucket, comp, n, binary_of(chunk.column(5))[0].view(np.uint16).reshape(-1, TREES * DEPTH), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _met(n: int, percent: int):
    """Links among the sets of each (comp, block), which come sorted; memory: one block."""

    def run(batches):
        held: list[tuple] = []
        last = None

        def found() -> pa.RecordBatch:
            home = np.array([x[0] for x in held], np.int64)
            root, guest = (np.array([x[k] for x in held]) for k in (2, 3))
            pairs = linked([x[1] for x in held], percent, root, guest if guest.any() else None) if len(np.unique(root)) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(home[[p[k] for p in pairs]] if pairs else home[:0]) for k in (0, 1)], names=["a", "b"])

        for batch, data, offsets in slices(batches, "text"):
            who = [batch.column(k).to_pylist() for k in range(5)]
            for comp, block, home, root, guest, s in zip(*who, shingle_sets(batch.num_rows, data, offsets, n), strict=True):
                if (comp, block) != last:
                    if len(held) > 1:
                        yield found()
                    held, last = [], (comp, block)
                if len(s):
                    held.append((home, s, root, guest))
        if len(held) > 1:
            yield found()

    return run


def cluster(docs: DataFrame, n: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; kept is the smallest doc_id of a component."""
    sc = docs.sparkSession.sparkContext
    text = documents_of(docs)
    rows = cut(text.mapInArrow(_described(n), "doc_id long, n long, set long, set2 long"))
    named = rows.where("doc_id is not null and n > 0")
    same_set = ["home", "set", "set2", "n"]
    homes = cut(named.groupBy("set", "set2", "n").agg(F.min("doc_id").alias("home")))
    known = text.where("doc_id is not null")
    signed = known.mapInArrow(_signed(sc.broadcast(bitmap_of(homes, "home")), n), "home long, set long, set2 long, n long, sig binary")
    signed = cut(signed.join(homes, same_set, "left_semi").dropDuplicates(same_set).select("home", "n", "sig"))

    # how deep each region is looked at
    depths = Depths()
    shared = cut(_shared(signed, "home", depths))
    all_shared = [shared]
    while len(depths.crowded) < DEPTH - SHALLOW:
        crowded = shared.where(F.col("times") > REGION)
        if crowded.isEmpty():
            break
        depths.crowded.append(sc.broadcast(bitmap_of(crowded, "key")))
        shared = cut(_shared(signed, "home", depths, only_last=True))
        all_shared.append(shared)
    regions = all_shared[0]
    for more in all_shared[1:]:
        regions = regions.unionByName(more)
    live = sc.broadcast(bitmap_of(regions, "key"))
    deepest = shared.where(F.col("times") > REGION)
    most = deepest.agg(F.max("times")).first()[0] or 0
    large = sc.broadcast(bitmap_of(deepest, "key")) if most else None

    def forest(placed: DataFrame) -> DataFrame:
        return placed.repartition("key", "split").sortWithinPartitions("key", "split").mapInArrow(_near_ones(percent), "a long, b long")

    alone = signed.select("home", "n", F.col("home").alias("comp"), "sig")
    edges = cut(forest(alone.mapInArrow(_dealt(depths, live, FIRST, large, -(-2 * most // REGION)), PLACED)))
    comps = components(edges)
    placed = cut(signed.join(comps.select(F.col("node").alias("home"), F.col("component").alias("comp")), "home", "left").select("home", "n", F.coalesce("comp", "home").alias("comp"), "sig"))
    drop_cut(signed)
    apart = cut(_shared(placed, "comp", depths, bits=live))
    mixed = sc.broadcast(bitmap_of(apart, "key"))
    hot_keys = apart.where(F.col("times") > REGION)
    if hot_keys.isEmpty():
        more = placed.mapInArrow(_dealt(depths, mixed, TREES), PLACED)
    else:
        hot = sc.broadcast(bitmap_of(hot_keys, "key"))
        more = placed.mapInArrow(_dealt(depths, mixed, TREES, hot, only_large=False), PLACED)
        visiting = placed.mapInArrow(_dealt(depths, mixed, TREES, hot, only_large=True), PLACED)
        major = visiting.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.ceil(2 * F.sum("count") / REGION).cast("int").alias("splits"))
        spread = F.when(F.col("comp") == F.col("major"), F.array(F.pmod(F.xxhash64("home", "key"), F.col("splits")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("splits") - 1))
        visiting = visiting.join(major, "key").withColumn("split", F.explode(spread)).select(*more.columns)
        more = more.unionByName(visiting)
    edges2 = cut(edges.unionByName(forest(more)))
    members = cut(components(edges2).toDF("home", "comp").join(placed.select("home", "n"), "home"))
    drop_cut(placed)

    # the sets of a group of near ones meet
    def links_of(met: DataFrame, bits) -> DataFrame:
        """met: home, comp, block, root, guest."""
        texts = known.mapInArrow(_held_by(bits), "doc_id long, text string").withColumnRenamed("doc_id", "home")
        meeting = texts.join(met, "home").select("comp", "block", "home", "root", "guest", "text")
        return cut(meeting.repartition("comp", "block").sortWithinPartitions("comp", "block").mapInArrow(_met(n, percent), "a long, b long"))

    sizes = members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = cut(members.join(sizes, "comp"))
    block = F.pmod(F.xxhash64("home"), F.col("blocks")).cast("int")
    links = links_of(own.select("home", "comp", block.alias("block"), F.col("home").alias("root"), F.lit(False).alias("guest")), sc.broadcast(bitmap_of(own, "home")))
    exact = components(links)
    again = []
    split = own.where("blocks > 1")
    if not split.isEmpty():
        rooted = cut(split.join(exact.toDF("home", "root"), "home", "left").withColumn("root", F.coalesce("root", "home")))
        major = rooted.groupBy("comp", "root").count().groupBy("comp").agg(F.max_by("root", F.struct("count", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
        rooted = rooted.join(major, "comp")
        stay = rooted.select("home", "comp", block.alias("block"), "root", F.lit(False).alias("guest"))
        visit = rooted.where("root != major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != block).select("home", "comp", "block", "root", F.lit(True).alias("guest"))
        again.append(links_of(stay.unionByName(visit), sc.broadcast(bitmap_of(rooted, "home"))))

    # documents that hold several texts join their sets
    several = named.groupBy("doc_id").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low != high").select("doc_id")
    if not several.isEmpty():
        again.append(named.join(several, "doc_id").join(homes, ["set", "set2", "n"]).select(F.col("doc_id").alias("a"), F.col("home").alias("b")))
    for more_links in again:
        exact = components(exact.toDF("a", "b").unionByName(more_links))
    out = rows.join(homes, ["set", "set2", "n"], "left").join(exact.toDF("home", "component"), "home", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "home", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
