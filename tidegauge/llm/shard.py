"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells.  Every shard owns ``vnodes`` cells chosen
by a hash of its number; a cell belongs to the first virtual node clockwise.
Rows hash to cells by their id.  Each shard takes rows up to its bound; the
rows of an arc that do not fit continue clockwise to the next virtual node
whose shard has room.  Bounds add up to the row count and differ by one at
most, so the law is ``rows``: counts are at most one apart.  Rows of equal text
are rows like any others: they are placed by their ids, so a large group of
copies fills no shard.

Only counts per arc (``shards * vnodes`` numbers, whatever the data size) reach
the driver, where the overflow is planned; rows are placed by one shuffle of
narrow columns on the arc, a rank within it, and a broadcast of the plan.

Defined cases: a null text has size 8 and the crc32 of no bytes; rows without
an id are placed by their text; repeated rows are placed each on its own; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, functions as F, Window

CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int, int]]:
    """Arcs clockwise as (first cell, last cell, shard); they cover the ring.

    A virtual node whose cell is taken moves on to the next free cell, in the
    order of shards, so adding a shard leaves all earlier nodes in place.
    """
    owner: dict[int, int] = {}
    for shard in range(shards):
        for replica in range(vnodes):
            cell = zlib.crc32(f"{shard}/{replica}".encode()) % CELLS
            while cell in owner:
                cell = (cell + 1) % CELLS
            owner[cell] = shard
    cells = sorted(owner)
    arcs, start = [], 0
    for cell in cells:
        arcs.append((start, cell, owner[cell]))
        start = cell + 1
    if start < CELLS:  # past the last node the ring closes at the first one
        arcs.append((start, CELLS - 1, owner[cells[0]]))
    return arcs


def plan_overflow(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, last rank, shard, slot of the first) under equal bounds."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    pieces, waiting = [], []

    def place(arc: int, done: int, shard: int) -> int:
        take = min(counts[arc] - done, room[shard])
        if take:
            pieces.append((arc, done, done + take - 1, shard, filled[shard]))
            room[shard] -= take
            filled[shard] += take
        return done + take

    for arc, shard in enumerate(owners):
        if (done := place(arc, 0, shard)) < counts[arc]:
            waiting.append((arc, done))
    for arc, done in waiting:
        at = arc
        while done < counts[arc]:
            at = (at + 1) % len(owners)
            done = place(arc, done, owners[at])
    return pieces


def _table(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table from driver values, as a literal in the plan."""
    schema = "array<struct<" + ",".join(f"{n}:bigint" for n in names) + ">>"
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def _position(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))


def shard_rows(docs: DataFrame, shards: int = 24, vnodes: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot (gapless from 0 per shard)."""
    spark = docs.sparkSession
    arcs = ring(shards, vnodes)
    cells = _table(spark, [(a, lo, hi) for a, (lo, hi, _) in enumerate(arcs)], ["arc", "lo", "hi"])
    cells = cells.select("arc", F.explode(F.sequence("lo", "hi")).alias("_cell"))
    octets = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    pos = _position(id_col, text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(octets) + 8).cast("long").alias("_size"),
        F.crc32(octets).alias("_crc"),
        pos.alias("_pos"),
        F.pmod(pos, F.lit(CELLS)).alias("_cell"),
    )
    # CELLS rows at most are broadcast
    counts = docs.select(F.pmod(pos, F.lit(CELLS)).alias("_cell")).groupBy("_cell").count()
    counts = counts.join(F.broadcast(cells), "_cell").groupBy("arc").agg(F.sum("count").alias("n"))
    per_arc = [0] * len(arcs)
    for r in counts.collect():  # one row per arc
        per_arc[r["arc"]] = r["n"]
    pieces = plan_overflow(per_arc, [s for *_, s in arcs], shards)
    plan = _table(spark, pieces, ["arc", "first", "last", "shard", "slot0"])
    ranked = rows.join(F.broadcast(cells), "_cell").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("arc").orderBy("_pos", "_id", "_crc", "_size")) - 1
    )
    plan = plan.withColumnRenamed("arc", "_arc")
    inside = (F.col("arc") == F.col("_arc")) & F.col("_rank").between(F.col("first"), F.col("last"))
    placed = ranked.join(F.broadcast(plan), inside)  # one row per arc and shard it spills to
    return placed.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("slot0") + F.col("_rank") - F.col("first")).alias("slot"),
    )
