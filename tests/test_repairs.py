"""Cases that once went wrong."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import compile as C
from tessera.operators import governance as G
from tessera.operators import retrieval as R


def test_json_arrays_keep_fields_that_nobody_named(spark):
    rows = spark.createDataFrame([(1, '[{"from":"a","note":"n","extra":{"x":[1,2]}},{"from":"b"}]'), (2, None), (3, " "), (4, "not json"), (5, "[]")], "id long, j string")
    new = F.struct(F.lit("c").alias("from"))
    found = {r.id: (r.more, r.less) for r in rows.select("id", T.json_append(F.col("j"), new).alias("more"), T.json_remove(F.col("j"), "from", F.lit("b")).alias("less")).collect()}
    assert found[1] == ('[{"from":"a","note":"n","extra":{"x":[1,2]}},{"from":"b"},{"from":"c"}]', '[{"from":"a","note":"n","extra":{"x":[1,2]}}]')
    assert found[2] == found[3] == found[5] == ('[{"from":"c"}]', "[]")
    assert found[4] == ("not json", "not json")


def test_vectors_that_are_no_numbers_hide_nothing(spark):
    nan, inf = float("nan"), float("inf")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.5, 0.5]), (4, [inf, 0.0])], "id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(9, [1.0, 0.1]), (10, [nan, 0.0])], "question_id long, embedding array<double>")
    assert [(r.question_id, r.id) for r in R.cosine_top_k(asked, vectors, 5).orderBy("rank").collect()] == [(9, 1), (9, 3)]


def test_blank_keys_join_no_sources(spark):
    bundles = spark.createDataFrame([(f"b{i}", "", "", None, []) for i in range(3)], "bundle_id string, name string, path_hash string, manifest_hash string, tops array<string>")
    sources = spark.createDataFrame([(i, "c", "ACTIVE", "UPLOAD", "", "", None, [], "", i) for i in range(4)], "source_id long, code string, status string, type string, name string, path_hash string, manifest_hash string, tops array<string>, summary string, ordinal long")
    assert {(r.decision, r.best) for r in C.decide_sources(bundles, sources).collect()} == {("NEW_SOURCE", 0)}


def test_a_review_repairs_each_row_once_a_round(spark):
    calls = spark.sparkContext.accumulator(0)

    def fix(rows):
        def seen(article):
            calls.add(1)
            return article

        return rows.withColumn("article", F.udf(seen)("article"))

    articles = spark.createDataFrame([(f"# body {i} sources: s", "s") for i in range(20)], "article string, sources string")
    assert G.review_loop(articles, fix, rounds=3).count() == 20
    assert calls.value == 60


def test_snippets_of_a_slug_are_told_apart_in_order(spark):
    rows = [(2, "A b", "t", "d", ["p2", "p1"], ["x", "y"]), (1, "a-b", "longer", "d2", ["p1"], ["y", "z", "y"]), (3, "other", "t", None, [], [])]
    found = {r.slug: (r.title, r.paths, r.snippets) for r in C.merge_concepts(spark.createDataFrame(rows, "position long, concept_id string, title string, description string, paths array<string>, snippets array<string>")).collect()}
    assert found == {"a-b": ("longer", ["p1", "p2"], ["y", "z", "x"]), "other": ("t", [], [])}
