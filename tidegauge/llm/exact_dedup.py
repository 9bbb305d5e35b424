"""Exact dedup by skew-safe combining of digest groups.

Three stages, and every one groups by the whole content next to its digest, so
no digest collision can merge different texts:

1. deduplicate locally: Spark's map-side partial aggregation merges the rows of
   one content and partition;
2. rows of a hot digest (more than ``salt_rows`` rows) are merged per (digest,
   salt, content), with as many salts as leave about ``salt_rows`` rows to each;
   all other digests have one salt, so this is their global stage already;
3. the salt winners of hot contents are combined globally by (digest, content).

The ids of a group travel with its content, at most about ``salt_rows`` of them
together, so the answer needs no join back on digests: only the salted groups
of hot contents meet their winner again, by content.  Contents cross the
network once.

Defined cases: a null text counts as the empty text; null ids lose against any
id; rows that repeat both id and text all carry ``kept`` when theirs is the id
that stays; very long texts are compared whole; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tidegauge.sources.scratch import materialise

#: The letters that compare equal.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

SALT_ROWS = 1024


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    text = F.coalesce(text, F.lit(""))
    # for pure ASCII the built-in lower case is the same and faster
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hot_digests(rows: DataFrame, salt_rows: int) -> DataFrame:
    """Digests of more than ``salt_rows`` rows, and how many salts each needs."""
    counts = rows.groupBy("_digest").agg(F.count("*").alias("_rows")).where(F.col("_rows") > salt_rows)
    return counts.select("_digest", F.ceil(F.col("_rows") / salt_rows).alias("_salts"))


def groups(docs: DataFrame, id_col: str, text_col: str, salt_rows: int, with_ids: bool) -> tuple[DataFrame, DataFrame]:
    """Stages 1 and 2: groups of whole contents, and the salted groups of hot ones with their content."""
    rows = docs.select(F.col(id_col).alias("_id"), fold_ascii(F.col(text_col)).alias("_content")).withColumn("_digest", F.sha2("_content", 256))
    hot = materialise(hot_digests(rows.select("_digest"), salt_rows), "hot-digests")
    # the written table's size is known: Spark broadcasts it if that is small, else joins by digest
    salt = F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_salts")), F.lit(-1).cast("long"))
    salted = rows.join(hot, "_digest", "left").withColumn("_salt", salt)
    found = [F.max("_id").alias("keep_id"), F.count("*").alias("group_size")]
    if with_ids:  # as structs, for lists leave nulls out
        found.append(F.collect_list(F.struct("_id")).alias("_ids"))
    merged = salted.groupBy("_digest", "_salt", "_content").agg(*found)
    narrow = merged.withColumns({"_mix": F.xxhash64("_content"), "_content": F.when(F.col("_salt") >= 0, F.col("_content"))})
    narrow = materialise(narrow, "digest-groups")
    return narrow.where("_salt < 0").drop("_salt", "_content"), narrow.where("_salt >= 0").drop("_salt")


def _winners(salted: DataFrame) -> DataFrame:
    """Stage 3: the winner and size of each hot content."""
    return salted.groupBy("_digest", "_content", "_mix").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    whole, salted = groups(docs, id_col, text_col, salt_rows, True)
    hot = salted.drop("keep_id", "group_size").join(_winners(salted), ["_digest", "_content", "_mix"])
    every = whole.unionByName(hot.select(whole.columns)).select("_digest", "keep_id", "group_size", F.explode("_ids._id").alias("_id"))
    return every.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = SALT_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; repeats of a row go too.

    Winners travel as narrow rows; whole rows cross the network once, to meet
    the winner of their id.  Rows that repeat an id and a content meet there too.
    """
    whole, salted = groups(docs, id_col, text_col, salt_rows, False)
    best = whole.select("keep_id", "_mix").unionByName(_winners(salted).select("keep_id", "_mix")).withColumn("_who", F.xxhash64("keep_id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col)).alias("_who"), F.xxhash64(fold_ascii(F.col(text_col))).alias("_mix"))
    kept = rows.join(best, (rows["_who"] == best["_who"]) & (rows["_mix"] == best["_mix"]) & rows["_id"].eqNullSafe(best["keep_id"]), "left_semi")
    one = F.row_number().over(Window.partitionBy("_who", "_mix").orderBy(F.lit(0)))
    return kept.withColumn("_one", one).where("_one = 1").select("row.*")
