"""Hard negatives, source divergence and the MinHash forest against their SQL or a plain version; edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import common, components, divergence, forest, negatives, queries

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"
DOCS = "doc_id long, text string, lang string, source string"


def same(found, wanted):
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, wanted), key=str)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_divergence"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.sql(queries.oracle_sql()[name])
    rows = queries.queries()[name](spark, SF)
    same(rows.select(*wanted.columns).collect(), wanted.fetchall())


# hard negatives


def plain_negatives(rows, every, k, low=80, scale=256):
    chosen = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if i not in chosen or (label, v) < chosen[i]:
            chosen[i] = (label, v)
    ints = {i: (label, [int(np.clip(np.floor(scale * x), -(1 << 27), 1 << 27)) for x in v]) for i, (label, v) in chosen.items()}
    out = []
    for a, (mine, v) in ints.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, label) for b, (label, w) in ints.items() if b != a)
        for s, p, _ in [x for x in scores if x[2] == mine][:k]:
            band = [(n, b) for n, b, label in scores if label != mine and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, p, r + 1, b, -s, -n) for r, (n, b) in enumerate(band)]
    return out


def test_negatives_of_clustered_vectors_with_ties_and_hot_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).round(2).tolist(), int(rng.integers(3))) for i in range(900)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(450)]  # a third of all rows
    df = spark.createDataFrame(rows, VECTORS)
    for options in ({}, {"regions": 4, "block": 100, "group": 7, "leaf": 8}, {"regions": 1, "leaf": 4}):
        same(negatives.mine(df, every=10, **options).collect(), plain_negatives(rows, 10, 5))


def test_negatives_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.9, 0.9], 2), (3, [nan, 1.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [inf, 1.0], 2), (7, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (2, [5.0, 5.0], 2), (8, [1.0], 2), (9, [], 2), (10, [-1.0, -1.0], 3), (11, [1e12, 1e12], 2), (12, [1.0, 0.9], 1), (12, [1.0, 0.9], 1)]
    found = negatives.mine(spark.createDataFrame(rows, VECTORS), every=1)
    same(found.collect(), plain_negatives(rows, 1, 5))
    clashing = spark.createDataFrame([(*r, 1.0, "x") for r in rows], f"{VECTORS}, score double, `anchor.id` string")
    same(negatives.mine(clashing, every=1).collect(), plain_negatives(rows, 1, 5))
    assert negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert negatives.mine(spark.createDataFrame([(0, [1.0], 1)], VECTORS)).count() == 0


def test_intervals_hold_all_products():
    rng = np.random.default_rng(2)
    a, c = rng.integers(-300, 300, (100, 5)), rng.integers(-300, 300, (333, 5))
    a, c = a[negatives.tree_order(a, 8)], c[negatives.tree_order(c, 8)]
    s = a @ c.T
    low, high = np.quantile(s, 0.99, axis=1).astype(int), np.full(100, 1 << 40)
    x, y, hi = negatives.leaf_pairs(ta := negatives.Tree(a, 8), tc := negatives.Tree(c, 8), low, high)
    ea, ec = negatives.borders(100, ta.depth), negatives.borders(333, tc.depth)
    kept = np.zeros(s.shape, bool)
    for i, j, h in zip(x, y, hi, strict=True):
        part = s[ea[i] : ea[i + 1], ec[j] : ec[j + 1]]
        assert part.max() <= h
        kept[ea[i] : ea[i + 1], ec[j] : ec[j + 1]] = True
    assert kept[s >= low[:, None]].all() and not kept.all()


# divergence


def plain_divergence(rows, least, top=10):
    groups, occurs, in_docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        groups[lang or "", source or ""].update(words)
        occurs[lang or ""].update(words)
        in_docs[lang or ""].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for (lang, source), mine in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        p = lambda counts: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        own, whole = p(mine), p(occurs[lang])
        pairs = sorted((-sum(f(own[t], q[t]) for t in kept), s) for (lg, s), c in groups.items() if lg == lang and s != source for q in [p(c)])
        terms = sorted((-f(own[t], whole[t]), t.encode()) for t in kept if mine[t] and own[t] > whole[t])[:top]
        out += [(lang, source, "pair", s, -v, r + 1) for r, (v, s) in enumerate(pairs)]
        out += [(lang, source, "term", t.decode(), -v, r + 1) for r, (v, t) in enumerate(terms)]
    return out


def test_divergence_edge_cases(spark):
    rows = [
        (1, "The cat, the CAT & the dog_food", "en", "a"),
        (2, "the cat sat. Éclair éclair ÉCLAIR 北京 ok", "en", "b"),
        (3, None, "en", "c"),
        (4, "", None, "a"),
        (5, "cat the dog éclair 北京", "en", None),
        (5, "cat the dog éclair 北京", "en", None),
        (6, "seul", "fr", "a"),
        (7, "x1y2z3 [cat]{the}", "en", "a"),
        (8, "the " * 50_000 + "cat", "en", "long"),
        (9, "tie\x00tie\x7fcat", "en", "a"),
    ]
    for least in (1, 2, 3):
        same(divergence.audit(spark.createDataFrame(rows, DOCS), least).collect(), plain_divergence(rows, least))
    more = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{DOCS}, term int, `a.b` string")
    same(divergence.audit(more, 2).collect(), plain_divergence(rows, 2))
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_divergence_flushes_full_dictionaries(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(20)), rng.choice(["en", "de"]), f"s{rng.randrange(5)}") for i in range(200)]
    same(divergence.audit(spark.createDataFrame(rows, DOCS)).collect(), plain_divergence(rows, 10))
    monkeypatch.setattr(divergence, "HELD", 30)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"lang": r[2], "source": r[3], "text": r[1]} for r in rows[at : at + 20]]) for at in range(0, 200, 20)]
    counts = Counter()
    for batch in divergence._counted(iter(batches)):
        for r in batch.to_pylist():
            if r["term"] is not None:
                counts[r["lang"], r["source"], r["term"]] += r["n"]
    assert counts == Counter((r[2], r[3], w) for r in rows for w in r[1].split())


# the forest


def plain_clusters(rows, n=4):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets]


def texts(seed=4):
    """Families of edited copies, on both sides of the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = []
    for length in (3, 5, 8, 20, 60, 300):
        for _ in range(4):
            base = [word() for _ in range(length)]
            rows.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 5, 8):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = word()
                rows.append((" " if edits else "\t").join(copy).upper() if edits == 1 else " ".join(copy))
    return list(enumerate(rows))


def test_forest_equals_all_pairs(spark):
    rows = texts()
    same(forest.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_clusters(rows))


def test_forest_with_crowded_regions_and_split_groups(spark, monkeypatch):
    monkeypatch.setattr(forest, "REGION", 3)
    monkeypatch.setattr(forest, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = texts(6)
    for i in range(60):  # a crowd about one text, some of which isn't linked with it
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(copy)))
    same(forest.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_clusters(rows))


def test_forest_edge_cases(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "two one"), (None, "one two"), (7, long), (8, long + " more"), (9, "a b c d e"), (9, "p q r s t"), (10, "p q r s t"), (11, "A b c d e"), (11, "A b c d e"), (-5, "one two"), (12, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(forest.cluster(df).collect(), plain_clusters(rows))
    clashing = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, home int, `set.n` string, component_id int")
    same(forest.cluster(clashing).collect(), plain_clusters(rows))
    assert forest.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_forest_query_over_its_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    same(queries.op13_minhash_forest(spark, SF).collect(), plain_clusters([(r["doc_id"], r["text"]) for r in t]))


def test_near_signatures_are_rare_misses():
    """Of pairs at the threshold nearly all agree in AGREE places and share a prefix in some tree."""
    rng, missed = np.random.default_rng(7), 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (80, 10, 10))
        x, y = (forest.signature(np.concatenate([common, z])) for z in (a, b))
        keys = forest.region_keys(np.stack([x, y]), forest.DEPTH)
        missed += forest.agreement(x, y) < forest.AGREE or not (keys[0] == keys[1]).any()
    assert missed == 0


def plain_components(edges):
    lead = {}

    def top(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            lead[high] = low
    return {x: top(x) for x in list(lead)}


def random_edges(seed):
    rng = np.random.default_rng(seed)
    chain = [(i + 1, i) for i in range(1000, 1200)]
    return chain + [(-5, 7), (7, -5), (3, 3), (7, 1 << 60)] + [tuple(x) for x in rng.integers(0, 500, (300, 2)).tolist()]


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_components_by_rounds_and_in_one_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    edges = random_edges(5)
    found = components.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == plain_components(edges)


def test_stars_hold_one_chunk():
    edges = np.array(random_edges(6), np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"]) for x in (edges[:7], edges[7:400], edges[400:])]
    for chunk in (1, 5, 64, 10_000):
        left = list(components.stars(chunk)(iter(batches)))
        assert all(b.num_rows <= 2 * chunk for b in left)
        assert plain_components([p for b in left for p in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True)]) == plain_components(edges.tolist())


def stages_of(spark, run):
    sc, group = spark.sparkContext, f"counted-{np.random.default_rng().integers(1 << 60)}"
    sc.setJobGroup(group, "")
    try:
        result = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    return result, len({s for j in jobs for s in j.stageIds})


def test_small_components_and_bitmaps_take_few_stages(spark):
    """Each stage has a task for every shuffle partition, however little there is to do."""
    edges = spark.createDataFrame(random_edges(7), "a long, b long").repartition(3).localCheckpoint()
    assert stages_of(spark, lambda: components.components(edges))[1] <= 6
    keys = np.random.default_rng(8).integers(-(1 << 62), 1 << 62, 5000)
    df = spark.createDataFrame([(int(x),) for x in keys], "k long").repartition(3).localCheckpoint()
    bits, stages = stages_of(spark, lambda: common.bitmap_of(df, "k"))
    assert common.in_bitmap(bits, keys.view(np.uint64)).all() and sum(int(x).bit_count() for x in bits) <= 5000
    assert stages <= 3
