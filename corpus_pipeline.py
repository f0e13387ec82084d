"""A training-data pipeline: quality, repeated lines, near copies, benchmark leaks, packing.

Each stage takes what its predecessor kept and returns the columns of documents, the last the packed pieces. ``run``
writes every stage as Parquet to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, linededup, packing, quality
from tessera.llm.common import columns_of, cut, free, made, release
from tessera.llm.queries import VOCABULARY, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of documents that aren't held out.

    Null and empty texts get the score of the bias alone; rows without a doc_id and repeated rows are judged each by their
    own text; texts are read whole, however long. Without labels all scores are 0.5 and nothing is kept.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    weights = quality.train(docs, labels.where(~quality.held_out()))
    score = free(docs, "score")
    return quality.score(docs, weights, keep_text=True, name=score).where(F.col(score) >= 0.7).select(*columns_of(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated line chunks, with n_chars of what is left; those of which nothing visible is left go.

    Texts that lose nothing stay as they are, null and empty ones too. Of repeated rows all keep the chunks that their
    doc_id holds first; a null doc_id comes after all others.
    """
    n_lines, n_removed = free(docs, "n_lines"), free(docs, "n_removed")
    rows = linededup.dedup(docs, n_lines, n_removed).where((F.col(n_removed) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col(n_removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*columns_of(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; of rows that repeat it the one with the smallest text, then the smallest row as JSON. Rows without a doc_id stay, and so do documents whose text is null or has no word."""
    firsts = jaccard.cluster(docs).where("doc_id = component_id").select("doc_id").distinct()
    place = free(docs, "place")
    first = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*columns_of(docs))))
    kept = docs.join(firsts, "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*columns_of(docs))
    return kept.unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, repeated rows are judged each. With an empty benchmark all stay."""
    matches = free(docs, "matches")
    return decontam.mark(docs, table(spark, sf_dir, "benchmark"), name=matches).where(F.size(matches) == 0).select(*columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens. A null or empty text is one piece of one token; repeated rows and rows without a doc_id are packed each; other columns aren't read."""
    return packing.pack(docs, VOCABULARY)


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_copies", keep_one_copy), ("decontamination", drop_leaks), ("packing", pack)]

#: The classifier and the tokeniser have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), made()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        release(spark, before, docs)
    return docs
