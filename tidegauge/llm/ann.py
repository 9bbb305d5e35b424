"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Vectors that are equal form one node, so copies cost nothing and are listed at
the end.  Nodes get one more component that makes all norms equal, after which
the largest inner product with a query is the nearest node.

The neighbour graph starts from exact neighbours within a few random blocks of
about ``block`` nodes and improves by NN-descent.  In each round every node
draws at most ``sample`` of its fresh and of its older edges, and as many reverse
edges of either kind; the nodes at their ends meet, are introduced to each other
where one of the two edges is fresh, and those nearer than a node's present
neighbours are merged in.  Edges that were not drawn stay fresh.  Nodes without
fresh edges send nothing.  Vectors travel to such meetings as 8-bit integers:
sending one vector to a meeting scores it against all others there, which takes
fewer bytes than sending it to the block of each candidate.  Rounds end when
fewer than ``settle`` of all edges change.

Search is greedy with a beam: per round, each query opens its best unopened
nodes, joins their neighbours, has them scored where their vectors lie (by
block of nodes) and keeps the best ``beam``.  Edges are followed both ways.  A
query that is a node itself starts from its own neighbours, any other from fixed
entry nodes; queries with equal vectors are searched once.  Scores of the result
are recomputed in double precision on the original vectors.

Defined cases: vectors null, empty, zero or holding null or non-finite
components take no part; those of one length are searched among themselves, since
an inner product takes two of the same; of rows that repeat an id the one with the least vector (component by
component) stands for the id; ties go to smaller ids; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from tidegauge.sources.scratch import discard, materialise

#: Nodes of a block, in the start graph and in the search.
BLOCK = 1024


def _block_of(node, blocks: int):
    """Block of a node id, alike for Spark columns and numpy arrays."""
    if isinstance(node, Column):
        return F.pmod(F.pmod(node, F.lit(1_000_003)) * 7919, F.lit(1_000_003)) % blocks
    return node % 1_000_003 * 7919 % 1_000_003 % blocks


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) with v as doubles, for the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _nodes(rows: DataFrame, copies: int) -> DataFrame:
    """One row per distinct vector: node (its least id), v, and its ``copies`` smallest ids."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    few = salted.withColumn("r", first).where(F.col("r") <= copies)
    few = few.groupBy("v", "salt").agg(F.collect_list("vec_id").alias("ids"))
    ids = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, copies)
    return few.groupBy("v").agg(ids.alias("ids")).select(F.col("ids")[0].alias("node"), "v", "ids")


def _pack_vectors(top_norm2: float):
    """Nodes with their vectors, extended to equal norms, as packed single floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            if not len(v):
                continue
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            more = np.sqrt(np.maximum(0, top_norm2 - (flat * flat).sum(axis=1)))
            full = np.concatenate([flat, more[:, None]], axis=1).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in full], pa.binary())], names=["node", "vec"])

    return run


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype="<f4").reshape(len(packed), -1)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` largest scores of each row, those above -inf."""
    k = min(k, scores.shape[1])
    cols = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(scores)), k)
    cols = cols.ravel()
    fine = scores[rows, cols] > -np.inf
    return rows[fine], cols[fine]


def _in_block(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["node"].to_numpy(), _matrix(pdf["vec"])
        out = []
        for at in range(0, len(ids), 2048):  # a block is scanned in strips
            s = x[at : at + 2048] @ x.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            r, c = _best(s, k)
            out.append(pd.DataFrame({"u": ids[at + r], "w": ids[c], "s": s[r, c]}))
        return pd.concat(out)

    return run


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as 8-bit integers with a scale."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("vec").to_pylist())
            scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30) / 127
            packed = np.concatenate([scale.astype("<f4").view(np.int8), np.rint(x / scale).astype(np.int8)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("m"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["m", "vec"])


def _large(packed) -> np.ndarray:
    """The vectors that ``_small`` made small."""
    rows = np.frombuffer(b"".join(packed), dtype=np.int8).reshape(len(packed), -1)
    return rows[:, 4:].astype(np.float32) * np.ascontiguousarray(rows[:, :4]).view("<f4")


def _introduce(top: int):
    """Pairs at each meeting that are nearer to each other than their worst neighbours, the ``top`` best of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            ends = lists.offsets.to_numpy()
            flat = lists.flatten()
            m, fresh, worst = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("m", "fresh", "worst"))
            x = _large(flat.field("vec").to_pylist()) if len(m) else None
            ends = ends - ends[0] if len(ends) else ends
            us, ws, ss = [], [], []
            for a, b in zip(ends[:-1], ends[1:]):
                ids, first = np.unique(m[a:b], return_index=True)
                if len(ids) < 2:
                    continue
                new = np.zeros(len(ids), bool)
                np.logical_or.at(new, np.searchsorted(ids, m[a:b]), fresh[a:b])
                at = a + first
                y = x[at]
                s = y @ y.T
                s[~(new[:, None] | new[None, :]) | (s <= worst[at][:, None])] = -np.inf
                np.fill_diagonal(s, -np.inf)
                r, c = _best(s, top)
                us.append(ids[r])
                ws.append(ids[c])
                ss.append(s[r, c])
            parts = [np.concatenate(p) if p else np.zeros(0, t) for p, t in ((us, np.int64), (ws, np.int64), (ss, np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in parts], names=["u", "w", "s"])

    return run


def _merge(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct neighbours of each node; edges found before stay as they are marked."""
    once = edges.groupBy("u", "w").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "w"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_graph(packed: DataFrame, n: int, k: int = 32, sample: int = 10, top: int = 8, blocks: int = 2, rounds: int = 12, settle: float = 0.05, block: int = BLOCK) -> DataFrame:
    """Edges (u, w, s, rank) of the NN-descent graph over ``packed`` (node, vec)."""
    parts = max(1, -(-n // block))
    starts = []
    for t in range(blocks):
        some = packed.withColumn("b", F.pmod(F.xxhash64("node", F.lit(t)), F.lit(parts)))
        starts.append(some.groupBy("b").applyInPandas(_in_block(k), "u long, w long, s float"))
    edges = starts[0]
    for more in starts[1:]:
        edges = edges.unionByName(more)
    small = materialise(packed.select(F.col("node").alias("m"), "vec").mapInArrow(_small, "m long, vec binary"), "small-vectors")
    edges = materialise(_merge(edges.withColumns({"fresh": F.lit(True), "old": F.lit(False)}), k), "graph-0")
    for i in range(rounds):

        def drawn(rows: DataFrame, node: str, other: str) -> Column:
            return F.row_number().over(Window.partitionBy(node, "fresh").orderBy(F.xxhash64(other, F.lit(i)))) <= sample

        last = edges
        edges = edges.withColumn("drawn", drawn(edges, "u", "w"))
        worst = edges.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("have"))
        worst = worst.select(F.col("u").alias("m"), F.when(F.col("have") < k, F.lit(float("-inf"))).otherwise(F.col("worst")).cast("float").alias("worst"))
        forward = edges.where("drawn").select(F.col("u").alias("c"), F.col("w").alias("m"), "fresh")
        back = edges.where("drawn").select(F.col("w").alias("c"), F.col("u").alias("m"), "fresh")
        back = back.withColumn("drawn", drawn(back, "c", "m")).where("drawn").drop("drawn")
        meetings = forward.unionByName(back).groupBy("c").agg(F.collect_list(F.struct("m", "fresh")).alias("all")).where(F.exists("all", lambda x: x["fresh"]))
        members = meetings.select("c", F.inline("all")).join(small.join(worst, "m"), "m")
        centres = members.groupBy("c").agg(F.collect_list(F.struct("m", "fresh", "worst", "vec")).alias("members"))
        found = centres.select("members").mapInArrow(_introduce(top), "u long, w long, s float")
        before = edges.select("u", "w", "s", (F.col("fresh") & ~F.col("drawn")).alias("fresh"), F.lit(True).alias("old"))
        both = before.unionByName(found.withColumns({"fresh": F.lit(True), "old": F.lit(False)}))
        edges = materialise(_merge(both, k), f"graph-{i + 1}")
        discard(last)
        if edges.where("not old").count() < settle * n * k:
            break
    discard(small)
    return edges


def _requests(beam: int, blocks: int):
    """Neighbours of opened nodes that are not in the beam yet, by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, vec, nodes, near in zip(pdf["q"], pdf["qvec"], pdf["nodes"], pdf["near"]):
                ask = np.setdiff1d(np.asarray(near, dtype=np.int64), np.asarray(nodes, dtype=np.int64))
                block = _block_of(ask, blocks)
                order = np.argsort(block, kind="stable")
                cuts = np.flatnonzero(np.diff(block[order])) + 1
                for part in np.split(ask[order], cuts) if len(ask) else []:
                    out.append((int(_block_of(part[0], blocks)), q, vec, part.tobytes()))
            yield pd.DataFrame(out, columns=["b", "q", "qvec", "ask"])

    return run


def _score(beam: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("node")
            ids, x = held["node"].to_numpy(), _matrix(held["vec"])
            for q, vec, ask in zip(asked["q"], asked["qvec"], asked["ask"]):
                nodes = np.frombuffer(ask, dtype="<i8")
                s = x[np.searchsorted(ids, nodes)] @ np.frombuffer(vec, dtype="<f4")
                if len(s) > beam:
                    at = np.argpartition(-s, beam - 1)[:beam]
                    nodes, s = nodes[at], s[at]
                out.append((q, nodes.tobytes(), s.astype("<f4").tobytes()))
        return pd.DataFrame(out, columns=["q", "nodes", "scores"])

    return run


def _take(beam: int, width: int):
    """Merge scored nodes into the beam and mark the next ones to open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, vec, nodes, scores, done, got in zip(pdf["q"], pdf["qvec"], pdf["nodes"], pdf["scores"], pdf["done"], pdf["got"]):
                n = [np.asarray(nodes, dtype=np.int64)] + [np.frombuffer(g["nodes"], dtype="<i8") for g in got]
                s = [np.asarray(scores, dtype=np.float32)] + [np.frombuffer(g["scores"], dtype="<f4") for g in got]
                n, s = np.concatenate(n), np.concatenate(s)
                d = np.concatenate([np.asarray(done, dtype=bool), np.zeros(len(n) - len(done), bool)])
                order = np.lexsort((n, -s))[:beam]
                n, s, d = n[order], s[order], d[order]
                opened = np.flatnonzero(~d)[:width]
                d[opened] = True
                out.append((q, vec, n.tolist(), s.tolist(), d.tolist(), n[opened].tolist()))
            yield pd.DataFrame(out, columns=["q", "qvec", "nodes", "scores", "done", "open"])

    return run


STATE = "q long, qvec binary, nodes array<long>, scores array<float>, done array<boolean>, open array<long>"


def graph_search(queries: DataFrame, packed: DataFrame, edges: DataFrame, n: int, beam: int = 192, width: int = 64, rounds: int = 4, entries: int = 64, reverse: int = 24, block: int = BLOCK) -> DataFrame:
    """(q, node, s): the beam of each of ``queries`` (q, qvec, node or null) after greedy search."""
    blocks = max(1, -(-n // block))
    held = packed.withColumn("b", _block_of(F.col("node"), blocks).cast("int"))
    # edges serve both ways, so that nodes nobody counts among its nearest are reached too
    nearest_back = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("s"), "u"))
    back = edges.select("u", "w", "s").withColumn("r", nearest_back).where(F.col("r") <= reverse)
    ways = edges.select("u", "w").unionByName(back.select(F.col("w").alias("u"), F.col("u").alias("w")))
    graph = materialise(ways.groupBy("u").agg(F.collect_set("w").alias("near")).withColumnRenamed("u", "open"), "ways")
    # fixed entry nodes, for queries that are no node of the index
    none = F.array().cast("array<long>")
    seeds = [F.lit(r["node"]) for r in packed.select("node").orderBy(F.xxhash64("node")).limit(entries).collect()]
    own = queries.join(graph.withColumnRenamed("open", "node"), "node", "left").withColumn("seeds", F.array(*seeds) if seeds else none)
    itself = F.when(F.col("node").isNotNull(), F.array("node")).otherwise(none)
    near = F.when(F.col("near").isNotNull(), F.concat("near", itself)).otherwise(F.concat("seeds", itself))
    state = own.select("q", "qvec", none.alias("nodes"), F.array().cast("array<float>").alias("scores"), F.array().cast("array<boolean>").alias("done"), near.alias("near"))
    for i in range(rounds + 1):
        last = state
        if i:
            opened = state.select("q", F.explode("open").alias("open")).join(graph, "open")
            near = opened.groupBy("q").agg(F.flatten(F.collect_list("near")).alias("near"))
            state = state.drop("open").join(near, "q", "left").withColumn("near", F.coalesce("near", none))
        asked = state.select("q", "qvec", "nodes", "near").mapInPandas(_requests(beam, blocks), "b int, q long, qvec binary, ask binary")
        scored = asked.groupBy("b").cogroup(held.groupBy("b")).applyInPandas(_score(beam), "q long, nodes binary, scores binary")
        got = scored.groupBy("q").agg(F.collect_list(F.struct("nodes", "scores")).alias("got"))
        empty = F.array().cast("array<struct<nodes:binary,scores:binary>>")
        merged = state.drop("near").join(got, "q", "left").withColumn("got", F.coalesce("got", empty))
        state = materialise(merged.mapInPandas(_take(beam, width), STATE), f"beam-{i}")
        if i:
            discard(last)
    pair = F.explode(F.arrays_zip("nodes", "scores"))
    return state.select("q", pair.alias("p")).select("q", F.col("p.nodes").alias("node"), F.col("p.scores").alias("s"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, graph: dict | None = None, **search) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row that ``is_query`` (of the column ``vec_id``) picks."""
    rows = materialise(usable(vectors, id_col, vec_col), "vectors")
    lengths = [r["k"] for r in rows.where(is_query).groupBy(F.size("v").alias("k")).count().orderBy("k").collect()]  # one row per length
    of = [rows.where(F.size("v") == n) for n in lengths] or [rows]
    return reduce(DataFrame.unionByName, [_nearest_of(same, is_query, k, block, graph, search) for same in of])


def _nearest_of(rows: DataFrame, is_query: Column, k: int, block: int, graph: dict | None, search: dict) -> DataFrame:
    """``nearest`` for vectors (vec_id, v) of one length."""
    nodes = materialise(_nodes(rows, k + 1), "nodes")
    n = nodes.count()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = nodes.agg(F.max(norm2)).first()[0] or 0.0
    packed = materialise(nodes.select("node", "v").mapInArrow(_pack_vectors(top), "node long, vec binary"), "packed")
    edges = neighbour_graph(packed, n, block=block, **(graph or {}))
    queries = materialise(rows.where(is_query).join(nodes.select("node", "v"), "v").select("vec_id", "node"), "queries")
    asked = queries.select("node").distinct().join(nodes.select("node", "v"), "node")
    flat = materialise(asked.mapInArrow(_pack_vectors(0.0), "node long, vec binary"), "query-vectors")
    found = graph_search(flat.select(F.col("node").alias("q"), F.col("vec").alias("qvec"), "node"), packed, edges, n, block=block, **search)
    # the nodes that can hold the k nearest and the query's own copies, then all their copies, scored exactly
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "node"))
    few = found.withColumn("r", rank).where(F.col("r") <= 2 * k + 1).select("q", "node")
    pairs = few.join(nodes, "node").join(asked.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
    score = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    listed = pairs.select("q", score.alias("score"), F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    listed = listed.withColumn("rank", place).where(F.col("rank") <= k + 1)
    lists = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    # a query leaves itself out; k of k + 1 rows remain at least, if there are so many
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    each = queries.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(lists, "q").select("query_id", F.posexplode(own).alias("at", "f"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", "f.score")
