"""Spelling variants: words one edit apart, found by pairs of trie nodes.

All words are put in a trie and, reversed, in a second one, and the nodes of
both are numbered.  A word split at a position then is a pair of integers, the
node of its prefix and the node of its suffix, however long both are; nothing is
hashed, so equal pairs are equal strings.  Each word writes the pair around
every character that may be skipped, and the pair at every place where a
character may be inserted:

* two words with one skipping pair in common differ in that character;
* a word whose inserting pair is another's skipping pair lacks that character.

The words of a pair share everything but one character.  So a group has one word
more than there are letters at most, and it is joined in one aggregation: every
member's neighbours in it are counted, and the most frequent one is picked,
without a row for each two of them.

Nodes are numbered from sorted words: a word's nodes up to what it shares with
the word before it are that word's, the others are new.  Range partitions number
on their own; how they go on from each other takes one row per partition (first
and last word, and the last one's nodes), settled on the driver and broadcast.
Node numbers of whole words are in code-point order.

Defined cases: null and empty texts have no words; rows without an id have no
deletions; a word of any length costs as many rows as it has letters; rows that
repeat count again; an empty table has no words; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.exact_dedup import fold_ascii
from tidegauge.sources.scratch import discard, materialise

#: Fixed value: what words are made of, once A-Z is lower-cased.
RUN = "[a-zÀ-ÿ]+"


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7, min_n: int = 2, delete_every: int | None = None) -> DataFrame:
    """(word, n): words of ``min_length`` code points that occur ``min_n`` times.

    ``delete_every`` = k plants misspellings: a word loses a letter where k divides the crc32 of ``<id>:<word>``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(fold_ascii(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("word"))
    rows = rows.where(F.length("word") >= min_length)
    if delete_every:
        h = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("word")))
        at = (h % F.length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        rows = rows.select(F.when(h % delete_every == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.length("word") >= min_length)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


#: A word's nodes by a partition's own numbers; in the partition's last row its borders, with the last word's nodes.
NUMBERED = pa.schema([("part", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("fresh", pa.int64())])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, last, nodes, fresh, part = None, "", [], 0, None
    for batch in batches:
        paths = []
        for key in batch.column("key").to_pylist():
            first = key if first is None else first
            same = shared(last, key)
            nodes = nodes[:same] + list(range(fresh, fresh + len(key) - same))
            fresh += len(key) - same
            last = key
            paths.append(nodes)
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
            gone = pa.nulls(batch.num_rows)
            columns = [batch.column("part"), batch.column("word"), batch.column("n"), pa.array(paths, pa.list_(pa.int64())), gone.cast(pa.string()), gone.cast(pa.string()), gone.cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=NUMBERED)
    if first is not None:
        yield pa.RecordBatch.from_pylist([{"part": part, "nodes": nodes, "first": first, "last": last, "fresh": fresh}], schema=NUMBERED)


def borders(parts: list) -> list[tuple[int, int, list[int], int]]:
    """(part, inherited, nodes of the inherited prefix, number of the first new node); 0 is the root of the trie."""
    out, last, nodes, following = [], "", [], 1
    for p in sorted(parts, key=lambda p: p["part"]):
        same = shared(last, p["first"])
        known = nodes[:same]
        out.append((p["part"], same, known, following))
        nodes = [known[x] if x < same else following + x - same for x in p["nodes"]]
        last, following = p["last"], following + p["fresh"] - same
    return out


def trie(words: DataFrame, key: Column, name: str) -> DataFrame:
    """(word, n, nodes): for each of ``words`` the numbers of the nodes on the path of ``key``, the root's first."""
    spark = words.sparkSession
    ordered = words.select("word", "n", key.alias("key")).repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    ddl = "part int, word string, n long, nodes array<long>, first string, last string, fresh long"
    numbered = materialise(ordered.mapInArrow(_number, ddl), name)
    ends = borders(numbered.where("first is not null").select("part", "nodes", "first", "last", "fresh").collect())  # one row per partition
    ends = spark.createDataFrame(ends, "part int, same long, known array<long>, following long")
    number = lambda x: F.when(x < F.col("same"), F.get("known", x.cast("int"))).otherwise(F.col("following") + x - F.col("same"))
    rows = numbered.where("first is null").join(F.broadcast(ends), "part")  # one row per partition
    return rows.select("word", "n", F.concat(F.array(F.lit(0).cast("long")), F.transform("nodes", number)).alias("nodes"))


def dictionary(words: DataFrame) -> DataFrame:
    """(node, word, n, prefixes, suffixes): ``words`` (word, n) with their nodes in both tries; ``node`` is the word's own."""
    forward = trie(words, F.col("word"), "trie").withColumnRenamed("nodes", "prefixes")
    backward = trie(words, F.reverse("word"), "trie-reversed").select("word", F.col("nodes").alias("suffixes"))
    return forward.join(backward, "word").select(F.element_at("prefixes", -1).alias("node"), "word", "n", "prefixes", "suffixes")


def pairs(entries: DataFrame) -> DataFrame:
    """(p, s, node, n, skips, leads): every word's skipping and inserting pairs.

    Of a run of one letter only the first (``leads``) says what the word is without a letter, so no neighbour counts twice.
    """
    size = F.length("word")
    letter = lambda i: F.get("letters", i)
    skipping = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.get("prefixes", i).alias("p"), F.get("suffixes", size - 1 - i).alias("s"), F.lit(True).alias("skips"), ((i == 0) | (letter(i) != letter(i - 1))).alias("leads")))
    inserting = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("prefixes", i).alias("p"), F.get("suffixes", size - i).alias("s"), F.lit(False).alias("skips"), F.lit(False).alias("leads")))
    rows = entries.withColumn("letters", F.split("word", ""))
    return rows.select("node", "n", F.explode(F.concat(skipping, inserting)).alias("pair")).select("pair.*", "node", "n")


def near(entries: DataFrame) -> DataFrame:
    """(node, n_near, best_n, best): how many words are one edit away, and the most frequent of them (ties: the first)."""
    member = F.struct((-F.col("n")).alias("less"), "node", "skips", "leads")
    # the words of a pair differ in one letter at most: a bounded list
    groups = pairs(entries).groupBy("p", "s").agg(F.array_sort(F.collect_list(member)).alias("words")).where(F.size("words") > 1)

    def others(x: Column) -> Column:
        return F.filter("words", lambda y: (y["node"] != x["node"]) & F.when(x["skips"], y["skips"] | x["leads"]).otherwise(y["skips"] & y["leads"]))

    found = F.transform("words", lambda x: F.struct(x["node"].alias("node"), others(x).alias("near")))
    rows = groups.select(F.explode(found).alias("f")).select("f.node", F.size("f.near").alias("k"), F.col("f.near")[0].alias("top")).where("k > 0")
    best = rows.groupBy("node").agg(F.sum("k").alias("n_near"), F.min(F.struct("top.less", "top.node")).alias("best"))
    return best.select("node", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.node").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(node, root): where the way from each of ``forms`` (node, form) ends; ways double with every round.

    A form is ``ratio`` times as frequent as its word, so ways are short and have no loops.
    """
    now = materialise(forms.select("node", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("further"))
        longer = materialise(now.join(ahead, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = longer.where("moved").limit(1).count()
        discard(now)
        now = longer.drop("moved")
        if not moved:
            return now


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every one of ``words`` (word, n).

    A word's form is its most frequent neighbour, if that is ``ratio`` times as frequent; its root is where forms lead.
    """
    words = materialise(words, "words")
    entries = materialise(dictionary(words), "dictionary")
    discard(words)
    form = F.col("best_n") >= F.col("n") * ratio
    known = entries.select("node", "word", "n").join(near(entries), "node", "left")
    known = materialise(known.select("node", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form_node"), F.when(form, F.col("best_n")).alias("form_n")), "spelling-near")
    discard(entries)
    formed = known.where("form_node is not null").select("node", "form_node")
    ends = roots(formed.withColumnRenamed("form_node", "form"))
    named = lambda name: known.select(F.col("node").alias(f"{name}_node"), F.col("word").alias(name))
    changed = formed.join(ends.withColumnRenamed("root", "root_node"), "node").join(named("form"), "form_node").join(named("root"), "root_node")
    rows = known.drop("form_node").join(changed.select("node", "form", "root"), "node", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
