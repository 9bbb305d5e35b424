"""Spelling variants against edit distances between all words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if one_edit(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        out[w] = (best if best is not None and counts[best] >= ratio * n else None, len(close))
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, counts[w], k, counts.get(form)))
    return sorted(rows, key=repr)


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)


def found(df):
    return sorted([(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(400):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(3, 6)))
        counts[w] = 10 ** rng.randint(0, 4) * rng.randint(1, 3)
    assert found(spelling.variants(words_of(spark, counts))) == brute(counts)


def test_chains_ties_and_long_words(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(4000))
    counts = {"mississippi": 5, "missisippi": 50, "missisipi": 500, "misisipi": 5000, "aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaab": 20, long: 2, long[:999] + long[1000:]: 40, long[:2000] + "z" + long[2001:]: 2, "alone": 3}
    assert found(spelling.variants(words_of(spark, counts))) == brute(counts)


def test_nodes_are_numbered_alike_over_any_partitions(spark):
    rng = random.Random(9)
    counts = dict.fromkeys({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)}, 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            rows = spelling.trie(words_of(spark, counts), F.col("word"), "trie").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        prefixes = {}
        for r in rows:
            assert len(r["nodes"]) == len(r["word"]) + 1
            for k, node in enumerate(r["nodes"]):
                assert prefixes.setdefault(r["word"][:k], node) == node
        assert sorted(prefixes.values()) == list(range(len(prefixes)))
        ends = sorted((r["word"], r["nodes"][-1]) for r in rows)
        assert [n for _, n in ends] == sorted(n for _, n in ends)


def test_counted_words(spark, odd):
    want = Counter()
    for i, text in [tuple(r) for r in odd.select("doc_id", "text").collect()]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 2 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = spelling.counted_words(odd, min_length=3, min_n=2, delete_every=2).collect()
    assert {r["word"]: r["n"] for r in got} == {w: n for w, n in want.items() if len(w) >= 3 and n >= 2}


def test_odd_tables(spark, odd, none):
    assert spelling.variants(spelling.counted_words(none)).count() == 0
    counts = {r["word"]: r["n"] for r in spelling.counted_words(odd, min_length=2).collect()}
    assert found(spelling.variants(spelling.counted_words(odd, min_length=2))) == brute(counts)
