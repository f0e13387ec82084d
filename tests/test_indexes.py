"""The persistent full-text and vector indexes against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fulltext, vectors

TEXTS = "id long, text string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_rank(question, text):
    """The sum over minimal covers by trying every stretch; None without a match."""
    wanted, held = set(words(question)), words(text)
    at = [(i, w) for i, w in enumerate(held) if w in wanted]
    if not wanted or {w for _, w in at} != wanted:
        return None
    full = [(i, j) for i in range(len(at)) for j in range(i, len(at)) if {w for _, w in at[i : j + 1]} == wanted]
    least = [(i, j) for i, j in full if not any(i <= a and b <= j and (a, b) != (i, j) for a, b in full)]
    return sum(0.1 / (1 + (at[j][0] - at[i][0]) - (j - i)) for i, j in least)


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcdefgh") + rng.choice(" ,.\n") for _ in range(rng.randrange(40)))) for i in range(n)]


QUESTIONS = [(1, "a"), (2, "b A"), (3, "c, d; e"), (4, "a b c d e f"), (5, "nowhere a"), (6, ""), (7, None), (8, "H h H"), (9, "Über straße")]


def check(found, texts, questions=QUESTIONS):
    got = {(r.question_id, r.id): round(r.score, 9) for r in found.collect()}
    wanted = {(q, i): round(s, 9) for q, question in questions for i, t in texts if i is not None and (s := plain_rank(question, t)) is not None}
    assert got == wanted


def test_rank_equals_plain_covers_and_replaced_documents_go(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    asked = spark.createDataFrame(QUESTIONS, "question_id long, question string")
    texts = [*corpus(), (900, None), (901, ""), (902, "über STRASSE Straße, Über"), (None, "a b")]
    assert fulltext.add(spark.createDataFrame(texts, TEXTS), "id", "text", folder, buckets=16) == 0
    check(fulltext.search(spark, asked, folder), texts)
    new = [(i, f"{t} a b c") for i, t in corpus(40, 2)] + [(5000, "a nowhere")]
    assert fulltext.add(spark.createDataFrame(new, TEXTS), "id", "text", folder) == 1
    texts = [(i, t) for i, t in texts if i not in dict(new)] + new
    check(fulltext.search(spark, asked, folder), texts)
    best = fulltext.search(spark, asked, folder, 3).collect()
    assert max(r["rank"] for r in best) == 3
    # postings without a commit are not seen
    half = fulltext.postings(spark.createDataFrame([(5001, "a b c d e f")], TEXTS), "id", "text")
    half = half.withColumn("version", F.lit("2-broken")).withColumn("bucket", fulltext.bucket_of(F.col("word"), 16))
    half.write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
    check(fulltext.search(spark, asked, folder), texts)
    fulltext.add(spark.createDataFrame([(5001, "a b")], TEXTS), "id", "text", folder)
    check(fulltext.search(spark, asked, folder), [*texts, (5001, "a b")])


def test_a_search_reads_the_buckets_of_its_words_only(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    fulltext.add(spark.createDataFrame([(i, f"w{i} w{i % 7}") for i in range(300)], TEXTS), "id", "text", folder, buckets=64)
    asked = spark.createDataFrame([(1, "w3 w10")], "question_id long, question string")
    needed = {r.b for r in spark.createDataFrame([("w3",), ("w10",)], "w string").select(fulltext.bucket_of(F.col("w"), 64).alias("b")).collect()}
    for name in ("postings", "words"):  # all other buckets are made unreadable
        for part in (tmp_path / "index" / name).glob("bucket=*"):
            if int(part.name.split("=")[1]) not in needed:
                for file in part.iterdir():
                    file.write_bytes(b"gone")
    schema = spark.read.parquet(f"{folder}/documents").schema  # still readable
    assert "generation" in schema.names
    found = fulltext.search(spark, asked, folder)
    assert [r.id for r in found.collect()] == [10]


def test_the_best_are_chosen_within_tasks(spark, tmp_path, monkeypatch):
    """More parts than one, more matches than k, equal ranks, halves at the last place; no row for a question and a document outside a task."""
    folder, texts = f"file://{tmp_path}/index", [*corpus(400, 5), *((1000 + i, "c d e") for i in range(30)), (2000, "a" + " x" * 511 + " h")]
    fulltext.add(spark.createDataFrame([(i, "z " + t) for i, t in texts[:200]], TEXTS), "id", "text", folder, buckets=8)
    fulltext.add(spark.createDataFrame(texts, TEXTS), "id", "text", folder)
    monkeypatch.setattr(fulltext, "DOCUMENTS", 40)
    monkeypatch.setattr(fulltext, "TERMS", 8)
    found = fulltext.search(spark, spark.createDataFrame(QUESTIONS, "question_id long, question string"), folder, 5, 9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "block" in plan
    half_up = lambda x: int(x * 1e9 + 0.5) / 1e9
    wanted = {q: sorted((-half_up(s), i) for i, t in texts if (s := plain_rank(question, t)) is not None)[:5] for q, question in QUESTIONS}
    got = {q: [] for q, _ in QUESTIONS}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got[r.question_id].append((-half_up(r.score), r.id))
    assert got == wanted and len(wanted[3]) == 5


def test_matches_are_ranked_like_plain_covers(monkeypatch):
    import pyarrow as pa

    texts = [*corpus(300, 7), (900, "b a " * 50), (901, "")]
    asked = fulltext.Asked(pa.array([q for q, t in QUESTIONS if words(t)]), pa.array([sorted(set(words(t))) for _, t in QUESTIONS if words(t)]))
    number = {w: i for i, w in enumerate(asked.words.to_pylist())}
    rows = [(d, number[w], p) for d, (_, t) in enumerate(texts) for p, w in enumerate(words(t), 1) if w in number]
    doc, word, place = map(np.array, zip(*rows, strict=True))
    for most in (60, 1 << 21):
        monkeypatch.setattr(fulltext, "RANKED", most)
        for k in (None, 4):
            best = fulltext.Best(len(asked.ids), k, 9)
            fulltext.match(asked, pa.array([i for i, _ in texts]), doc, word, place, best)
            got = {(r["question_id"], r["id"]): round(r["score"], 9) for r in best.batch(asked, pa.int64()).to_pylist()}
            wanted = {}
            for q, question in QUESTIONS:
                scores = sorted((-round(s, 9), i) for i, t in texts if (s := plain_rank(question, t)) is not None)
                wanted |= {(q, i): -s for s, i in (scores if k is None else scores[:k])}
            assert got == wanted


def test_missing_index_and_no_words(spark, tmp_path):
    asked = spark.createDataFrame(QUESTIONS, "question_id long, question string")
    with pytest.raises(ValueError):
        fulltext.search(spark, asked, f"file://{tmp_path}/none")
    fulltext.add(spark.createDataFrame([(1, "a")], TEXTS), "id", "text", f"file://{tmp_path}/one")
    assert fulltext.search(spark, asked.where("question_id in (6, 7)"), f"file://{tmp_path}/one").count() == 0


# vectors

VECTORS = "id long, embedding array<double>"


def plain_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        scores = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), i) for i, w in rows]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def nearest(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.question_id, []).append(r.id)
    return out


def test_vector_lists(spark, tmp_path):
    rng, folder = np.random.default_rng(3), f"file://{tmp_path}/v"
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]  # one vector many times
    odd = [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6), (2003, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6)]
    assert vectors.build(spark.createDataFrame(rows + odd, VECTORS), folder, lists=12) == 6
    asked = [(i, rows[i][1]) for i in range(0, 400, 40)]
    queries = spark.createDataFrame([*asked, (7777, [1.0, 2.0]), (7778, None)], "question_id long, embedding array<double>")
    assert nearest(vectors.search(spark, queries, folder, 5)) == plain_nearest(rows, asked, 5)
    moved = [(i, [-x for x in v]) for i, v in rows[:50]] + [(3000, rows[7][1])]
    assert vectors.add(spark.createDataFrame(moved, VECTORS), folder) == 1
    now = [*moved, *rows[50:]]
    assert nearest(vectors.search(spark, queries, folder, 5)) == plain_nearest(now, asked, 5)
    few = vectors.search(spark, queries, folder, 5, probes=1)
    assert "PartitionFilters: [isnotnull(list" in (plan := few._jdf.queryExecution().executedPlan().toString()) or "PartitionFilters: [list" in plan
    assert all(len(x) <= 5 for x in nearest(few).values())
    with pytest.raises(ValueError):
        vectors.add(spark.createDataFrame([(1, [1.0, 2.0])], VECTORS), folder)
    assert vectors.exists(spark, folder) and not vectors.exists(spark, f"{folder}-none")


def test_realign_keeps_what_fits(spark, tmp_path):
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 1.0, 0.0])], VECTORS)
    with pytest.raises(ValueError):
        vectors.build(mixed, f"file://{tmp_path}/a")
    anew = vectors.realign(mixed, f"file://{tmp_path}/b", 3, lists=2)
    assert sorted(r.id for r in anew.collect()) == [1, 3]
    asked = spark.createDataFrame([(9, [0.0, 2.0, 0.1])], "question_id long, embedding array<double>")
    assert nearest(vectors.search(spark, asked, f"file://{tmp_path}/b", 2)) == {9: [4, 2]}


def test_recall_grows_with_the_probes(spark, tmp_path):
    rng, folder = np.random.default_rng(4), f"file://{tmp_path}/r"
    x = rng.normal(size=(4000, 16))
    rows = list(enumerate(x.tolist()))
    vectors.build(spark.createDataFrame(rows, VECTORS), folder, lists=40, rounds=4)
    asked = rows[::100]
    queries = spark.createDataFrame(asked, "question_id long, embedding array<double>")
    true = plain_nearest(rows, asked, 10)
    recall = []
    for probes in (2, 10, 20):
        found = nearest(vectors.search(spark, queries, folder, 10, probes=probes))
        recall.append(np.mean([len(set(found[q]) & set(true[q])) / 10 for q in true]))
    assert recall == sorted(recall) and recall[-1] >= 0.9
