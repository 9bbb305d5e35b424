"""Corpus pipeline over ``documents``: language, copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``; the last returns
the pieces of packed sequences.

Defined cases: language ID rejects null and empty texts, texts without a letter
and texts of which the model knows no word and no n-gram; a short text is no
reason to go.  Of rows that repeat a text one stays.  Rows without an id pass
the near-copy stage; rows that repeat an id and a size get the same number of
copies in the mixture.  Texts are whole at every stage, however long.  An empty
table stays empty, and columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import exact_dedup, jaccard, langid, mixing, packing
from tidegauge.llm.queries import vocabulary
from tidegauge.sources.scratch import discard, materialise


#: Bytes of texts that go to a Python worker at a time; each task holds such a batch, and what grows from it, on both sides.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """From now on this session's texts go to Python a few megabytes at a time, instead of Spark's 64."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from this very input."""
    in_small_batches(spark)
    judge = langid.judge(spark, langid.fit(docs.where(~langid.held_out())))
    judged = docs.select(F.struct(*docs.columns).alias("doc"), judge(F.col("text")).alias("judged"))
    kept = judged.where((F.col("judged.lang_pred") != langid.UNKNOWN) & F.col("judged.explained"))
    return kept.select("doc.*")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document id of each component of similar shingle sets."""
    in_small_batches(spark)
    linked = jaccard.jaccard_components(docs)
    gone = linked.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their token targets."""
    taken = mixing.mix(docs).groupBy("doc_id", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), mixing.word_count("text").alias("words"))
    same = rows["id"].eqNullSafe(taken["doc_id"]) & (rows["words"] == taken["size"])
    return rows.join(taken, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences."""
    in_small_batches(spark)
    return packing.pack(docs, vocabulary(), end_id=0, with_ids=False)


STAGES = [("language ID", language), ("exact dedup", copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("packing", packed)]

#: SQL can express neither the language model nor the mixture; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)  # a stage's copy of the corpus goes once the next one is written
    return STAGES[-1][1](spark, docs, sf_dir)
