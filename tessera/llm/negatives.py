"""Hard-negative mining by dual-tree search on integer inner products.

An anchor's positives are its best rows of the same label; its hard negatives are the best rows of other labels whose score
lies in a band below a positive's score. Both are the same search: the first k rows, by score and then by smaller id, whose
score lies in [low, high] and whose label is equal (or is not).

Trees stand over candidates and anchors. A split tree fitted on a bounded sample (``sample`` rows, smallest hashes first)
deals all rows into ``regions``, each with a ball that covers all its rows; regions are dealt by hash into blocks of about
``block`` rows, anchors of a region into groups of ``group``, and each block and each group is put into the order of a
balanced tree of its own. A pair of nodes with centres a, c and radii r, s has inner products within
a.c -+ (r|c| + s|a| + rs): pairs of an anchor group and a region are dropped by this interval before anything is shuffled,
pairs of nodes within a task before their leaves meet, and the leaf pairs that remain are scored exactly. Bounds start from
a first search of each group in its own region, and rise as leaves are scored, best interval first.

Candidates are shuffled by block and stay whole; a task holds one block and streams the anchor groups past it, so memory
doesn't depend on the number of rows, labels or anchors, and rows that share one vector are spread over blocks like any
others. Where vectors are isotropic in many dimensions the intervals prune next to nothing, and all anchors meet all rows
in blocks.

Rows take no part whose id, label or vector is null or whose vector holds a null or non-finite component. Components are
floor(scale * x), held within +-2**27 (so scores of up to 512 such components are exact); a shorter vector counts as
filled up with zeros, an empty one as zero. Of rows that repeat an id the one with the smallest (label, vector) counts. An
anchor without another row of its label, or a positive without a negative in its band, gives no rows; so does an empty
table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEAST, MOST = -(1 << 62), 1 << 62
LIMIT = 1 << 27


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vec (little-endian 32-bit integers) of the rows that take part, one for each id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ints = np.clip(np.floor(scale * flat), -LIMIT, LIMIT).astype("<i4")
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))) * 4
            vec = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ints)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec], names=["vec_id", "label", "vec"])

    return rows.mapInArrow(run, "vec_id long, label long, vec binary")


def matrix(cells: list[bytes], width: int) -> np.ndarray:
    """The packed vectors, filled up with zeros."""
    if all(len(x) == 4 * width for x in cells):
        return np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), width)
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in cells), "<i4").reshape(len(cells), width)


class Splits:
    """A tree of hyperplanes with sample medians as borders; deals vectors into regions."""

    def __init__(self, sample: np.ndarray, regions: int, seed: int):
        rng = np.random.default_rng(seed)
        self.depth = regions.bit_length() - 1
        width = sample.shape[1]
        self.axis, self.border = np.zeros((regions, width)), np.zeros(regions)
        for node in range(1, regions):
            level = node.bit_length() - 1
            mine = sample[self.region(sample, level) == node - (1 << level)]
            if len(mine) >= 2:
                # from the mean of one half at random to the other's: near the direction of most spread after two looks
                axis = rng.normal(size=width)
                for _ in range(3):
                    along = mine @ axis
                    upper = along > np.median(along)
                    if not upper.any():
                        break
                    axis = mine[upper].mean(0) - mine[~upper].mean(0)
                self.axis[node], self.border[node] = axis, np.median(mine @ axis)

    def region(self, v: np.ndarray, levels: int | None = None) -> np.ndarray:
        node = np.ones(len(v), np.int64)
        for _ in range(self.depth if levels is None else levels):
            side = np.zeros(len(v), np.int64)
            for k in np.unique(node):
                mine = node == k
                side[mine] = v[mine] @ self.axis[k] > self.border[k]
            node = 2 * node + side
        return node - (1 << (self.depth if levels is None else levels))


def borders(n: int, level: int) -> np.ndarray:
    return n * np.arange((1 << level) + 1) // (1 << level)


def depth_of(n: int, leaf: int) -> int:
    return max(0, -(-n // leaf) - 1).bit_length()


def tree_order(v: np.ndarray, leaf: int) -> np.ndarray:
    """An order in which the runs between ``borders`` are the nodes of a balanced tree: medians of the widest coordinate."""
    order, n = np.arange(len(v)), len(v)
    for level in range(depth_of(n, leaf)):
        ends = borders(n, level + 1)
        for k in range(1 << level):
            low, mid, high = ends[2 * k], ends[2 * k + 1], ends[2 * k + 2]
            if low < mid < high:
                part = v[order[low:high]]
                along = part[:, (part.max(0) - part.min(0)).argmax()]
                order[low:high] = order[low:high][np.argpartition(along, mid - low)]
    return order


class Tree:
    """Centres, norms of centres and radii of the nodes of each level, over vectors in tree order."""

    def __init__(self, v: np.ndarray, leaf: int):
        x = v.astype(np.float64)
        self.n, self.depth, self.levels = len(v), depth_of(len(v), leaf), []
        for level in range(self.depth + 1):
            ends = borders(self.n, level)
            count = np.diff(ends)
            centre = np.add.reduceat(x, ends[:-1]) / count[:, None]
            away = ((x - np.repeat(centre, count, axis=0)) ** 2).sum(1)
            self.levels.append((centre, np.linalg.norm(centre, axis=1), np.sqrt(np.maximum.reduceat(away, ends[:-1]))))

    def over(self, level: int, values: np.ndarray, ufunc: np.ufunc) -> np.ndarray:
        return ufunc.reduceat(values, borders(self.n, level)[:-1])


def interval(a: np.ndarray, an: np.ndarray, ar: np.ndarray, c: np.ndarray, cn: np.ndarray, cr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of pairs of balls, widened by what rounding may take."""
    mid = np.einsum("ij,ij->i", a, c)
    out = ar * cn + cr * an + ar * cr
    out += 1e-9 * (out + an * cn) + 1e-6
    return mid - out, mid + out


class Wanted:
    """The rows of a search in one group of anchors: for each its anchor, bounds, and the best k so far."""

    def __init__(self, of: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, k: int):
        self.of, self.low, self.high, self.ids, self.labels, self.same, self.k = of, low, high, ids, labels, same, k
        self.score, self.who = np.full((len(of), k), LEAST), np.full((len(of), k), MOST)

    def floor(self) -> np.ndarray:
        return np.maximum(self.low, self.score[:, -1])

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        """Scores: rows x ids."""
        floor = np.maximum(self.low[rows], self.score[rows, -1])
        i, j = np.nonzero((scores >= floor[:, None]) & (scores <= self.high[rows][:, None]))
        anchor = self.of[rows[i]]
        ok = ((labels[j] == self.labels[anchor]) == self.same) & (ids[j] != self.ids[anchor])
        i, j = i[ok], j[ok]
        if not len(i):
            return
        some = rows[np.unique(i)]
        row = np.concatenate([np.repeat(some, self.k), rows[i]])
        score = np.concatenate([self.score[some].ravel(), scores[i, j].astype(np.int64)])
        who = np.concatenate([self.who[some].ravel(), ids[j]])
        order = np.lexsort((who, -score, row))
        row, score, who = row[order], score[order], who[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        top = place < self.k
        self.score[row[top], place[top]], self.who[row[top], place[top]] = score[top], who[top]


def leaf_pairs(a: Tree, c: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves whose interval may hold a wanted score, and the interval's upper end. low, high: of each anchor."""
    x = y = np.zeros(1, np.int64)
    la = lc = 0
    while True:
        lo, hi = interval(*(p[x] for p in a.levels[la]), *(p[y] for p in c.levels[lc]))
        ok = (hi >= a.over(la, low, np.minimum)[x]) & (lo <= a.over(la, high, np.maximum)[x])
        x, y, hi = x[ok], y[ok], hi[ok]
        if not len(x) or (la, lc) == (a.depth, c.depth):
            return x, y, hi
        if la < a.depth:
            x, y, la = np.concatenate([2 * x, 2 * x + 1]), np.concatenate([y, y]), la + 1
        if lc < c.depth:
            x, y, lc = np.concatenate([x, x]), np.concatenate([2 * y, 2 * y + 1]), lc + 1


#: Leaves of candidates that are scored at once, before bounds are looked at again.
TOGETHER = 16


def search(anchors: np.ndarray, a: Tree, v: np.ndarray, c: Tree, ids: np.ndarray, labels: np.ndarray, wanted: Wanted) -> None:
    """Adds to ``wanted`` what a block (vectors in tree order) holds for a group of anchors (in tree order)."""
    most = float(np.sqrt((anchors.astype(np.float64) ** 2).sum(1).max()) * np.sqrt((v.astype(np.float64) ** 2).sum(1).max()))
    kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else np.int64  # in which all sums are exact
    low, high = np.full(len(anchors), MOST), np.full(len(anchors), LEAST)
    np.minimum.at(low, wanted.of, wanted.floor())
    np.maximum.at(high, wanted.of, wanted.high)
    x, y, hi = leaf_pairs(a, c, low, high)
    ends_a, ends_c = borders(len(anchors), a.depth), borders(len(v), c.depth)
    v = v.astype(kind)
    for leaf in np.unique(x):
        mine = np.flatnonzero(x == leaf)
        mine = mine[np.argsort(-hi[mine], kind="stable")]
        first, last = ends_a[leaf], ends_a[leaf + 1]
        rows = np.flatnonzero((wanted.of >= first) & (wanted.of < last))
        q = anchors[first:last].astype(kind)
        for at in range(0, len(mine), TOGETHER):
            some = mine[at : at + TOGETHER]
            some = np.sort(y[some[hi[some] >= wanted.floor()[rows].min()]])
            if not len(some):
                break
            cols = np.concatenate([np.arange(ends_c[k], ends_c[k + 1]) for k in some])
            scores = q @ v[cols].T
            wanted.add(rows, scores[wanted.of[rows] - first], ids[cols], labels[cols])


def runs(keys: list[np.ndarray]) -> list[int]:
    n = len(keys[0])
    change = np.zeros(max(0, n - 1), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), n]


FOUND = "anchor long, band long, vec_id long, score long"


def _searched(width: int, leaf: int, same: bool, k: int):
    """Rows come sorted by (block, role, party, place): a block's vectors, then the groups of anchors that visit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, party, visitors = None, [], None, []
        tree = v = ids = labels = None

        def taken(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
            return np.concatenate([p.column(p.schema.names.index(name)).to_numpy() for p in parts])

        def vectors(parts: list[pa.RecordBatch]) -> np.ndarray:
            return matrix([x for p in parts for x in p.column(p.schema.names.index("vec")).to_pylist()], width)

        def visit() -> pa.RecordBatch:
            anchors, names = vectors(visitors), taken(visitors, "vec_id")
            lows, highs = ([x for p in visitors for x in p.column(p.schema.names.index(c)).to_pylist()] for c in ("lows", "highs"))
            of = np.repeat(np.arange(len(names)), [len(x) for x in lows])
            low, high = (np.array([y for x in z for y in x], np.int64) for z in (lows, highs))
            wanted = Wanted(of, low, high, names, taken(visitors, "label"), same, k)
            if len(of):
                search(anchors, Tree(anchors, leaf), v, tree, ids, labels, wanted)
            i, j = np.nonzero(wanted.who < MOST)
            return pa.RecordBatch.from_arrays([pa.array(names[of[i]]), pa.array(high[i]), pa.array(wanted.who[i, j]), pa.array(wanted.score[i, j])], names=["anchor", "band", "vec_id", "score"])

        for batch in batches:
            column = lambda c: batch.column(batch.schema.names.index(c)).to_numpy()  # noqa: E731, B023
            number, role, group = column("block"), column("role"), column("party")
            cuts = runs([number, role, group])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if visitors and (number[lo], role[lo], group[lo]) != (block, 1, party):
                    yield visit()
                    visitors = []
                if number[lo] != block:
                    block, held, tree = number[lo], [], None
                if role[lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                elif held or tree is not None:
                    if held:
                        v, ids, labels = vectors(held), taken(held, "vec_id"), taken(held, "label")
                        tree, held = Tree(v, leaf), []
                    party = group[lo]
                    visitors.append(batch.slice(lo, hi - lo))
        if visitors:
            yield visit()

    return run


def _placed(width: int, leaf: int):
    """Rows come sorted by block; adds each row's place in its block's tree, and the ball of the block (with its first row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ordered() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            v = matrix(rows.column(rows.schema.names.index("vec")).to_pylist(), width)
            order = tree_order(v, leaf)
            rows = rows.take(pa.array(order))
            centre, _, radius = (x[0] for x in Tree(v, len(v)).levels[0])
            none = [None] * (len(v) - 1)
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.arange(len(v))), pa.array([centre.tolist(), *none], pa.list_(pa.float64())), pa.array([float(radius), *none], pa.float64())], names=[*rows.schema.names, "place", "centre", "radius"])

        for batch in batches:
            cuts = runs([batch.column(batch.schema.names.index("block")).to_numpy()])
            for n, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                at = part.schema.names.index("block")
                if held and (n or held[-1].column(at)[0] != part.column(at)[0]):
                    yield ordered()
                    held = []
                held.append(part)
        if held:
            yield ordered()

    return run


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, regions: int = 64, block: int = 65536, group: int = 512, leaf: int = 64, sample: int = 4096, seed: int = 11) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose id is divisible by ``every`` and each of its ``positives``, the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= 100 * positive_score. Needs vec_id, label, embedding."""
    spark = vectors.sparkSession
    rows = cut(packed(vectors, scale))
    n, width = rows.agg(F.count("*"), F.max(F.length("vec") / 4)).first()
    width = max(1, int(width or 0))
    regions = 1 << (regions.bit_length() - 1)
    seen = rows.select("vec").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).collect()  # at most ``sample`` rows
    splits = Splits(matrix([bytes(r.vec) for r in seen], width).astype(np.float64), regions, seed)
    block = min(block, max(1024, n // (4 * spark.sparkContext.defaultParallelism)))  # smaller tables keep all cores busy

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = splits.region(matrix(batch.column(2).to_pylist(), width).astype(np.float64)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region.astype(np.int32))], names=[*batch.schema.names, "region"])

    in_regions = cut(rows.mapInArrow(dealt, "vec_id long, label long, vec binary, region int"))
    asks = F.col("vec_id") % every == 0

    def blocks_of(df: DataFrame, most: int) -> DataFrame:
        """The rows with their block's number, in tree order; a region's rows are dealt evenly by the hashes of their ids."""
        sizes = F.broadcast(df.groupBy("region").agg(F.ceil(F.count("*") / most).alias("blocks")))  # a row for each region
        number = F.col("region") + F.lit(regions) * F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col("blocks"))
        numbered = df.join(sizes, "region").select("vec_id", "label", "vec", "region", number.cast("long").alias("block"))
        kind = "vec_id long, label long, vec binary, region int, block long, place long, centre array<double>, radius double"
        return cut(numbered.repartition("block").sortWithinPartitions("block").mapInArrow(_placed(width, leaf), kind))

    candidates = blocks_of(in_regions, block)
    anchors = blocks_of(in_regions.where(asks), group).withColumnRenamed("block", "party")
    # the ball of a region holds the balls of its blocks; both tables have a row for each region at most
    balls = candidates.where("radius is not null").select("region", "block", "centre", "radius")
    middle = balls.groupBy("region").agg(F.min_by("centre", "block").alias("middle"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "middle", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    covering = balls.join(F.broadcast(middle), "region").groupBy("region").agg(F.first("middle").alias("middle"), F.max(apart + F.col("radius")).alias("radius"))
    balls_at = covering.orderBy("region").collect()
    numbers = np.array([r.region for r in balls_at], np.int32)
    centres = np.array([r.middle for r in balls_at], np.float64).reshape(len(numbers), width)
    radii = np.array([r.radius for r in balls_at], np.float64)
    norms = np.linalg.norm(centres, axis=1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(party, region) for the regions that a group of anchors has to visit."""
        for batch in batches:
            party, region = [], []
            for name, centre, radius, least, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = np.broadcast_to(np.array(centre), centres.shape)
                lo, hi = interval(a, np.linalg.norm(a, axis=1), np.full(len(radii), radius), centres, norms, radii)
                some = numbers[(hi >= least) & (lo <= most)]
                party.append(np.full(len(some), name, np.int64))
                region.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(party or [np.zeros(0, np.int64)])), pa.array(np.concatenate(region or [numbers[:0]]))], names=["party", "region"])

    def found(asking: DataFrame, same: bool, k: int, own: bool = False) -> DataFrame:
        """anchor, band (the upper bound), vec_id, score: the first k of each anchor's bounds. own: in the anchors' own regions only."""
        if own:
            visits = asking.select("party", "region").distinct()
        else:
            least, most = F.min(F.array_min("lows")), F.max(F.array_max("highs"))
            bounds = asking.groupBy("party").agg(least.alias("least"), most.alias("most")).where("least is not null")
            ball = anchors.where("radius is not null").select("party", "centre", "radius")
            visits = ball.join(bounds, "party").mapInArrow(met, "party long, region int")
        where = visits.join(F.broadcast(balls.select("region", "block")) if own else balls.select("region", "block"), "region").select("party", "block")
        nothing = F.lit(None).cast("array<long>")
        asked = asking.select("party", "place", "vec_id", "label", "vec", "lows", "highs").join(where, "party")
        visiting = asked.select("block", F.lit(1).alias("role"), "party", "place", "vec_id", "label", "vec", "lows", "highs")
        standing = candidates.select("block", F.lit(0).alias("role"), F.lit(0).cast("long").alias("party"), "place", "vec_id", "label", "vec", nothing.alias("lows"), nothing.alias("highs"))
        both = standing.unionByName(visiting).repartition("block").sortWithinPartitions("block", "role", "party", "place")
        best = both.mapInArrow(_searched(width, leaf, same, k), FOUND)
        order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anything = lambda lows: (F.array(lows).alias("lows"), F.array(F.lit(MOST).cast("long")).alias("highs"))
    seats = anchors.select("party", "region", "place", "vec_id", "label", "vec")
    near = found(seats.select("*", *anything(F.lit(LEAST).cast("long"))), True, positives, own=True)
    floors = near.where(F.col("rank") == positives).select(F.col("anchor").alias("vec_id"), F.col("score").alias("floor"))
    bounded = seats.join(floors, "vec_id", "left").select("party", "place", "vec_id", "label", "vec", *anything(F.coalesce("floor", F.lit(LEAST).cast("long"))))
    best = cut(found(bounded, True, positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # bands of positives; one for each different score
    floor = F.ceil(F.expr(f"cast({low} as decimal(10,0)) * positive_score / 100")).cast("long")
    bands = best.select("anchor", floor.alias("low"), F.col("positive_score").alias("high")).distinct().where("low <= high")
    lists = bands.groupBy("anchor").agg(F.array_sort(F.collect_set(F.struct("high", "low"))).alias("bands"))  # ``positives`` at most
    banded = seats.join(lists.withColumnRenamed("anchor", "vec_id"), "vec_id").select("party", "place", "vec_id", "label", "vec", F.col("bands.low").alias("lows"), F.col("bands.high").alias("highs"))
    hard = found(banded, False, negatives).select("anchor", F.col("band").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = best.join(hard, ["anchor", "positive_score"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The contract of the query, by brute force.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
