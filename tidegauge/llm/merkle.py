"""Merkle manifest of a dataset: one tree per group, one over the groups, a proof for every row.

Rows of a group stand in order and have a rank.  A rank in base ``fanout`` is a
path through the tree, so the tree is built by grouping its digits away, lowest
first: a group of rows that differ in one digit only becomes their parent, which
nests its children as structs.  That happens within blocks of
``fanout ** block_levels`` neighbouring rows, which all rounds find in one
partition: one exchange serves every round.  A block's top node is a row of the
next stage, where the same happens to the block numbers, until each group is one
block; the groups' top nodes then are the rows of the last tree.

Proofs come down the same way.  A nested block holds every digest that its rows
need, so a transform over the nested arrays lists them and an explode emits a
row for each; what lies above the block reaches it by a union and a grouping of
two rows (the block and its path), never by a join.

No task holds more than a block, however many rows a group has.  Ranks come
from a range partitioning of (group, key, digest): a row's place in its
partition, and one small row per (group, partition) that says how many stand
before it.

Defined cases: a null group is a group, and comes first; null keys come first in
their group; rows that repeat a key stand in order of their digests, equal rows
are told apart by their place in the input; an empty table has no rows and no
root; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.sources.scratch import discard, materialise

FANOUT, BLOCK_LEVELS = 3, 6
_MOST_LEVELS = 39


def encode(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row from its values, in order."""
    return F.sha2(F.concat(*map(encode, values)), 256)


def _levels(n: Column, fanout: int) -> Column:
    """Rounds until ``n`` nodes have become one."""
    powers = F.array(*[F.lit(fanout**k).cast("long") for k in range(_MOST_LEVELS) if fanout**k < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, key, digest, item) as (tree, rank, n, digest, item): place in the tree, and its size."""
    told = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-rows")  # the tie is fixed before it orders anything
    order = ["tree", "key", "digest", "tie"]
    # the ids of a sorted partition are consecutive: partition number and place
    placed = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialise(placed.select("tree", "digest", "item", "at"), "merkle-order").withColumn("part", F.shiftright("at", 33))
    discard(told)
    stretches = placed.groupBy("tree", "part").agg(F.min("at").alias("start"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")  # one row per partition that holds rows of the tree
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = stretches.select(F.col("tree").alias("tree_"), F.col("part").alias("part_"), (before - F.col("start")).alias("shift"), F.sum("rows").over(of_tree).alias("n"))
    same = (placed["part"] == stretches["part_"]) & placed["tree"].eqNullSafe(stretches["tree_"])
    return placed.join(stretches, same).select("tree", (F.col("at") + F.col("shift")).alias("rank"), "n", "digest", "item")


def _stage(nodes: DataFrame, base: int, fanout: int, levels: int) -> DataFrame:
    """Blocks (tree, n, block, digest, kids) of nodes that stand ``base`` levels above the leaves."""
    digit = lambda k: F.expr(f"cast(rank div {fanout**k} % {fanout} as int)").alias(f"d{k}")
    block = F.expr(f"rank div {fanout**levels}").alias("block")
    rows = nodes.select("tree", "n", block, *[digit(k) for k in range(levels)], "digest", F.col("item").alias("down")).repartition("tree", "block")
    for level in range(1, levels + 1):
        keys = ["tree", "n", "block", *[f"d{k}" for k in range(level, levels)]]
        # a parent has at most ``fanout`` children
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{level - 1}").alias("d"), "digest", "down")))
        parents = rows.groupBy(*keys).agg(kids.alias("down"))
        joined = F.sha2(F.array_join(F.col("down.digest"), ""), 256)
        rows = parents.withColumn("digest", F.when(_levels(F.col("n"), fanout) >= base + level, joined).otherwise(F.col("down.digest")[0]))
    return rows.withColumnRenamed("down", "kids")


def grow(nodes: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """Stages of blocks over ranked leaves; in the last each tree is one block, whose digest is the tree's root."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    stages, base = [], 0
    while True:
        stages.append(materialise(_stage(nodes, base, fanout, block_levels), "merkle-blocks"))
        base += block_levels
        if fanout**base >= largest:
            return stages
        nodes = stages[-1].select("tree", "n", F.col("block").alias("rank"), "digest", F.struct("block").alias("item"))


def _emit(kids: Column, level: int, base: int, depth: Column, above: Column) -> Column:
    """Leaves below ``kids`` with the siblings on their way up, lowest level first."""

    def step(kid: Column, i: Column) -> Column:
        digests = kids["digest"]
        side = F.struct(F.array_join(F.slice(digests, 1, i), "").alias("left"), F.array_join(F.slice(digests, i + 2, F.size(digests)), "").alias("right"))
        path = F.when(depth >= base + level, F.concat(F.array(side), above)).otherwise(above)
        if level == 1:
            return F.array(F.struct(kid["down"].alias("item"), kid["digest"].alias("digest"), path.alias("path")))
        return _emit(kid["down"], level - 1, base, depth, path)

    return F.flatten(F.transform(kids, step))


def descend(stages: list[DataFrame], above: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, item, digest, path, told) for every leaf; ``above`` (tree, path, told) is what each tree's root has above it."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for s in range(len(stages) - 1, -1, -1):
        lost = lambda of, name: F.lit(None).cast(of.schema[name].dataType).alias(name)
        rows = stages[s].select("tree", "block", "n", "kids", lost(above, "path"), lost(above, "told"))
        ways = above.select("tree", "block", lost(stages[s], "n"), lost(stages[s], "kids"), "path", "told")
        # two rows a group: the block, and its way up
        met = rows.unionByName(ways).groupBy("tree", "block").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in ("n", "kids", "path", "told")])
        leaves = _emit(F.col("kids"), block_levels, s * block_levels, _levels(F.col("n"), fanout), F.col("path"))
        above = met.select("tree", "told", F.explode(leaves).alias("leaf")).select("tree", "told", "leaf.*")
        if s:
            above = above.select("tree", "item.block", "path", "told")
    return above


def proofs(rows: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, item, digest, path, subroot, root) for each of ``rows`` (tree, key, digest, item).

    ``path`` holds, level by level from the leaf to the root, the digests left and right of the node, each side joined.
    """
    stages = grow(ranked(rows), fanout, block_levels)
    tops = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.struct("tree").alias("item"))
    crown = grow(ranked(tops), fanout, block_levels)
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    subroots = descend(crown, crown[-1].select("tree", nothing.alias("path"), F.struct(F.col("digest").alias("root")).alias("told")), fanout, block_levels)
    above = subroots.select("item.tree", "path", F.struct(F.col("digest").alias("subroot"), "told.root").alias("told"))
    return descend(stages, above, fanout, block_levels).select("tree", "item", "digest", "path", "told.subroot", "told.root")


def manifest(docs: DataFrame, values: list[str], group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """A proof for every row of ``docs``: key, group, what ``carry`` names, leaf, path, subroot, root."""
    item = F.struct(F.col(key).alias("key"), *[c.alias(name) for name, c in (carry or {}).items()])
    rows = docs.select(F.col(group).alias("tree"), F.col(key).alias("key"), leaf_digest(*[F.col(v) for v in values]).alias("digest"), item.alias("item"))
    found = proofs(rows, fanout, block_levels)
    return found.select(F.col("item.key").alias(key), F.col("tree").alias(group), *[F.col("item")[name].alias(name) for name in carry or {}], F.col("digest").alias("leaf"), "path", "subroot", "root")


def siblings_digest(path: Column) -> Column:
    """One digest of all siblings on a path, in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
