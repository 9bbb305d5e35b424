"""Merkle manifest against a plain recursive one."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import merkle

VALUES = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path_of(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        i //= fanout
    return out


def brute(rows, fanout=3):
    """(doc_id, source, leaf, path, subroot, root) of each row of VALUES."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], leaf_of(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels_of([leaf for _, leaf in groups[s]], fanout)
    top = levels_of([trees[s][-1][0] for s in order], fanout)
    return [
        (i, s, leaf, tuple(path_of(trees[s], k, fanout) + path_of(top, at, fanout)), trees[s][-1][0], top[-1][0])
        for at, s in enumerate(order)
        for k, (i, leaf) in enumerate(groups[s])
    ]


def found(df):
    return [(r["doc_id"], r["source"], r["leaf"], tuple((s["left"], s["right"]) for s in r["path"]), r["subroot"], r["root"]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("fanout, block_levels", [(3, 6), (3, 1), (2, 2)])
def test_odd_rows(odd, fanout, block_levels):
    rows = [tuple(r) for r in odd.select(*VALUES).collect()]
    assert ordered(found(merkle.manifest(odd, VALUES, fanout=fanout, block_levels=block_levels))) == ordered(brute(rows, fanout))


def test_many_groups_and_a_hot_one(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"s{rng.randrange(40):02}", None, i, f"text {i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    assert ordered(found(merkle.manifest(df, VALUES, block_levels=2))) == ordered(brute(rows))


def test_empty_and_single(spark, odd, none):
    assert merkle.manifest(none, VALUES).count() == 0
    one = odd.where("doc_id = 100")
    (row,) = merkle.manifest(one, VALUES).collect()
    assert row["path"] == [] and row["leaf"] == row["subroot"] == row["root"]


def test_tampering_shows(odd):
    proven = merkle.manifest(odd.where("doc_id is not null"), VALUES, carry={"other": merkle.leaf_digest(*map(F.col, VALUES[:4]), F.concat("text", F.lit("!")))})
    rows = proven.select(
        "doc_id", "root", merkle.folded(F.col("leaf"), F.col("path")).alias("own"), merkle.folded(F.col("other"), F.col("path")).alias("changed"), merkle.siblings_digest(F.col("path")).alias("proof"), "path", F.col("other") == F.col("leaf")
    ).collect()
    assert rows and all(r["own"] == r["root"] for r in rows)
    assert all((r["changed"] == r["root"]) == r[-1] for r in rows)
    assert all(r["proof"] == sha("".join(s["left"] + s["right"] for s in r["path"])) for r in rows)


def test_one_exchange_serves_all_levels(spark, odd):
    nodes = merkle.ranked(odd.select(F.col("source").alias("tree"), F.col("doc_id").alias("key"), F.lit("x").alias("digest"), F.struct("doc_id").alias("item")))
    plan = merkle._stage(nodes, 0, 3, 4)._jdf.queryExecution().sparkPlan().toString()
    full = merkle._stage(nodes, 0, 3, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") == 8 and full.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(tree#" in full
    assert full.split("REPARTITION_BY_COL")[0].count("Exchange") == 1
