"""The operators on documents against brute force on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import odd_rows  # noqa: F401  (tests/llm/conftest.py)
from tidegauge.llm import exact_dedup, jaccard, langid, line_dedup, mixing, packing, shard, simple8b, token_files, tokens
from tidegauge.sources.scratch import scratch_path

ROWS = [(r[0], r[1]) for r in odd_rows()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup(spark, odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[hashlib.sha256(lower(t).encode()).hexdigest()].append(i)
    assert len(got) == len(ROWS)
    for r in got:
        ids = groups[r["text_sha256"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert r["doc_id"] in ids and (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_hot_digests_are_salted(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    hot = exact_dedup.hot_digests(df.select(F.sha2(exact_dedup.fold_ascii(F.col("text")), 256).alias("_digest")), 100).collect()
    assert [r["_salts"] for r in hot] == [10]
    got = exact_dedup.exact_dedup(df, salt_rows=100)
    assert got.count() == 3000
    got = got.where("group_size > 1").collect()
    assert len(got) == 1000 and {r["keep_id"] for r in got} == {2997} and {r["group_size"] for r in got} == {1000} and sum(r["kept"] for r in got) == 1
    kept = exact_dedup.drop_copies(df, salt_rows=100)
    assert kept.count() == 2001 and kept.where("text = 'Hot'").collect() == [(2997, "Hot")]


@pytest.mark.parametrize("salt_rows", [1024, 1])
def test_drop_copies(spark, odd, salt_rows):
    best = {}
    for r in odd_rows():
        key = lower(r[1])
        if key not in best or (r[0] is not None and (best[key] is None or r[0] > best[key])):
            best[key] = r[0]
    kept = exact_dedup.drop_copies(odd, salt_rows=salt_rows).collect()
    assert Counter((lower(r["text"]), r["doc_id"]) for r in kept) == Counter(best.items())
    rows = {tuple(r) for r in odd_rows()}
    assert all(tuple(r) in rows for r in kept)


def test_sharding(spark, odd, none):
    got = shard.shard_rows(odd, 5, 16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 5
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert shard.shard_rows(none, 5, 16).count() == 0


@pytest.mark.parametrize("shards,vnodes", [(5, 16), (3, 2), (7, 1)])
def test_placement_row_by_row(spark, odd, shards, vnodes):
    """Every row walks the ring clockwise from its place until a shard has room; rows on their own arcs come first."""
    many = odd.select("doc_id", "text").unionByName(spark.range(1000, 1600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text")))
    rows = many.select("doc_id", "text", shard._position("doc_id", "text").alias("pos")).collect()
    arcs = shard.ring(shards, vnodes)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    on_arc = defaultdict(list)
    for r in rows:
        cell = r["pos"] % shard.CELLS
        data = (r["text"] or "").encode()
        arc = next(i for i, (lo, hi, _) in enumerate(arcs) if lo <= cell <= hi)
        on_arc[arc].append((r["pos"], (r["doc_id"] is not None, r["doc_id"] or 0), zlib.crc32(data), len(data) + 8, r["doc_id"]))
    filled, want, waiting = [0] * shards, [], []

    def put(row, s):
        want.append((row[4], row[3], row[2], s, filled[s]))
        filled[s] += 1

    for arc in range(len(arcs)):
        for row in sorted(on_arc[arc]):
            s = arcs[arc][2]
            if filled[s] < room[s]:
                put(row, s)
            else:
                waiting.append((arc, row))
    for arc, row in waiting:
        at = arc
        while filled[arcs[at][2]] >= room[arcs[at][2]]:
            at = (at + 1) % len(arcs)
        put(row, arcs[at][2])
    got = [tuple(r) for r in shard.shard_rows(many, shards, vnodes).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert Counter(got) == Counter(want)


def test_ring_keeps_nodes_and_moves_little(spark):
    before, after = shard.ring(24, 64), shard.ring(25, 64)
    assert sum(hi - lo + 1 for lo, hi, _ in before) == shard.CELLS
    nodes, later = ({hi: s for _, hi, s in arcs[:-1]} for arcs in (before, after))
    assert all(later[cell] == s for cell, s in nodes.items())
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a, b = (shard.shard_rows(docs, n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (24, 25))
    moved = a.join(b, "doc_id").where("s24 != s25").count()
    assert 20_000 / 25 <= moved < 0.25 * 20_000


def brute_lines(rows):
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 20 and i is not None:
                docs[key].add(i)
    drop = {k: max(v) for k, v in docs.items() if len(v) >= 3}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or drop.get(lower(x.strip(" \t\n\x0b\x0c\r")), i) == i]
        yield i, "\n".join(kept), len(lines), len(lines) - len(kept)


def test_line_dedup(spark, odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*odd.columns, "keep_bitmap"]
    found = Counter((r["doc_id"], *line_dedup.apply_bitmap(r["text"] or "", r["keep_bitmap"])) for r in got.collect())
    assert found == Counter(brute_lines(ROWS))
    assert line_dedup.dedup_lines(none).count() == 0


def test_runs_cut_by_partition_borders(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one very common line of text\nline number "), F.col("id"), F.lit(" stands alone")).alias("text"))
    lost = line_dedup.keep_bitmaps(df.repartition(7))
    assert lost.count() == 1999 and lost.agg(F.max("doc")).first()[0] == 1998


def test_lines_of_repeated_and_missing_ids(spark):
    line, other = "a line that is long enough to count", "another line that is long enough to count"
    rows = [(1, f"{line}\nx"), (1, f"y\n{line}"), (2, line), (None, line), (None, other), (3, other), (4, other), (5, f"{other}\n{other}"), (5, other), (5, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(df).collect()
    found = Counter((r["doc_id"], *line_dedup.apply_bitmap(r["text"] or "", r["keep_bitmap"])) for r in got)
    assert found == Counter(brute_lines(rows))
    assert found[(1, f"{line}\nx", 2, 0)] == 1 and found[(3, "", 1, 1)] == 1


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("min_docs", [2, 3, 4])
def test_verdicts_of_cut_streams(batch, min_docs):
    rng = np.random.default_rng(batch * 10 + min_docs)
    for _ in range(40):
        rows = sorted(((int(h), 0, int(d), int(t)) for h, d, t in zip(rng.integers(0, 4, 24), rng.integers(0, 6, 24), rng.integers(0, 2, 24))), key=lambda r: (r[0], -r[2]))
        docs = defaultdict(set)
        for h, _, d, _ in rows:
            docs[h].add(d)
        want = Counter((d, t) for h, _, d, t in rows if len(docs[h]) >= min_docs and d != max(docs[h]))
        # partitions as ranges of (hash, document) cut them
        bounds = sorted({(r[0], -r[2]) for r in rows})
        cuts = sorted(rng.choice(len(bounds), min(2, len(bounds)), replace=False).tolist())
        parts = [[r for r in rows if sum((r[0], -r[2]) >= bounds[c] for c in cuts) == k] for k in range(3)]
        lost, open_, counts = Counter(), [], defaultdict(list)
        for part in parts:
            table = pa.RecordBatch.from_pylist([{"h1": h, "h2": g, "doc": d, "tag": t, "at": [0]} for h, g, d, t in part], schema=pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.list_(pa.int32()))]))
            for out in line_dedup._verdicts(min_docs)(iter([table.slice(i, batch) for i in range(0, len(part), batch)])):
                for r in out.to_pylist():
                    if r["doc"] is None:
                        counts[r["h1"]].append((r["n"], r["first"]))
                    elif r["h1"] is None:
                        lost[(r["doc"], r["tag"])] += 1
                    else:
                        open_.append(r)
        assert sum(map(len, counts.values())) <= 2 * 3
        for r in open_:
            n, first = sum(n for n, _ in counts[r["h1"]]), max(f for _, f in counts[r["h1"]])
            if n >= min_docs and r["doc"] != first:
                lost[(r["doc"], r["tag"])] += 1
        assert lost == want


def brute_components(rows):
    def words(t):
        return [lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]

    sets, parent = [], {}
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if i is not None and j is not None and both and 100 * both >= 80 * (len(s) + len(t) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return Counter((i, len(s), None if i is None else find(i)) for i, s in sets)


@pytest.mark.parametrize("long,heavy", [(32, 16), (4, 3)])
def test_jaccard(spark, odd, none, monkeypatch, long, heavy):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    got = jaccard.jaccard_components(odd).collect()
    assert Counter(tuple(r) for r in got) == brute_components(ROWS)
    assert jaccard.jaccard_components(none).count() == 0


def test_boundary_follows_cost():
    assert jaccard.boundary(0.0, 80, 100) <= jaccard.boundary(2.0, 80, 100) <= jaccard.boundary(9.0, 80, 100)


def test_mixing(spark, odd, none):
    got = mixing.mix(odd).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, count(t)) for i, t in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    assert Counter(got) == Counter(mixing.mix(odd.repartition(5)).collect())
    assert mixing.mix(none).count() == 0


def test_multipliers_and_copies_against_brute_force(spark, odd):
    """Bisection on each source's plain sum; copies near the tilted rates; every size's copies add up to what was planned for it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    sizes = defaultdict(list)
    for r in docs.collect():
        sizes[r["source"]].append((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
    names = sorted(sizes, key=lambda s: (s is None, s))
    totals = [sum(n for _, n in sizes[s]) for s in names]
    targets = dict(zip(names, mixing.source_targets(totals, [1 + i % 3 for i in range(len(names))])))
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    for name, total in zip(names, totals):
        mean = max(1.0, total / len(sizes[name]))
        low, high = -500.0, 500.0
        for _ in range(200):
            mid = (low + high) / 2
            mass = sum(n * min(3.0, np.exp(min(mid * n / mean, 5))) for _, n in sizes[name])
            low, high = (mid, high) if mass < targets[name] else (low, mid)
        by_size, planned = defaultdict(list), Counter()
        for i, n in sizes[name]:
            r = got[i]
            assert r["size"] == n and r["source_size"] == total and r["target"] == pytest.approx(targets[name])
            by_size[n].append(r["copies"])
            planned[n] += min(3.0, np.exp(min(low * n / mean, 5))) if n else 0.0
        for n, copies in by_size.items():
            assert max(copies) - min(copies) <= 1 and abs(sum(copies) - planned[n]) <= max(3.0, 0.1 * planned[n]), (name, n)


def test_a_hot_size_is_dealt_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUB", 4)
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "one two").otherwise(F.repeat(F.lit("w "), F.col("id").cast("int"))).alias("text"), F.lit("s").alias("source"))
    rows = docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("src"), mixing.word_count("text").alias("size"), F.lit(1).alias("source_size"), F.lit(1.0).alias("target"))
    cells = rows.groupBy("src", "size").agg(F.count("*").alias("n")).withColumns({"base": F.lit(1), "extra": F.floor(F.col("n") * 0.37)})
    got = mixing._dealt(rows, cells, "doc_id").cache()
    assert got.count() == 900
    extra = {r["size"]: r["e"] for r in got.groupBy("size").agg(F.sum(F.col("copies") - 1).alias("e")).collect()}
    assert extra == {r["size"]: r["extra"] for r in cells.collect()}


def test_unsettled_multipliers_raise(spark, odd):
    with pytest.raises(RuntimeError):
        mixing.mix(odd, steps=1).count()


def test_targets():
    assert mixing.source_targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    assert mixing.source_targets([10, 200, 90], [1, 1, 1]) == [30.0, 135.0, 135.0]
    assert mixing.source_targets([0, 10], [5, 1]) == [0.0, 10.0]
    assert mixing.source_targets([], []) == []


def test_mixture_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert len(got) == 20 and all(abs(r["t"] / r["g"] - 1) < 0.005 for r in got)


def batched(texts, vocabulary, end=None):
    """Ids of each text as the operators encode them, a portion at a time."""
    out = []
    for at, ids, ends in tokens.encode_texts(pa.array(texts, pa.string()), vocabulary, end):
        assert at == len(out)
        out += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    return out


@pytest.mark.parametrize("portion,generation", [(8_000_000, 200_000), (100, 20)])
def test_pieces_equal_whole_texts(vocabulary, monkeypatch, portion, generation):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "PORTION", portion)
    monkeypatch.setattr(tokens, "GENERATION", generation)
    rng = np.random.default_rng(5)
    texts = [t for _, t in ROWS if len(t or "") < 5000]
    texts += ["".join(rng.choice(list(" \n\tab.'s\xa0\x1cé1\r\0ß漢"), rng.integers(0, 14))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["word", "Word,", "it's", "naïve!", "«x»", "3.14", "漢字", "a-b", "\nend", "x\ny"], rng.integers(1, 9))) for _ in range(300)]
    fresh = Tokenizer.from_file(vocabulary)
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert batched(texts, vocabulary) == want
    assert batched(texts, vocabulary, 2) == [[*x, 2] for x in want]
    assert batched([], vocabulary) == []


def test_parts_of_pieces_are_encoded_once(vocabulary):
    """A word that is known without its punctuation, and punctuation that is known after another word, are not encoded again."""
    memory = tokens._memory.__wrapped__(vocabulary)
    model, asked = memory.model, []

    class Counted:
        def tokenize(self, text):
            asked.append(text)
            return model.tokenize(text)

    memory.model = Counted()
    keys = ["alpha", "alpha,", "beta,", "b\u00eata,", "\nbeta", "\0alpha", "alpha's", "1,", "..."]
    assert [list(np.frombuffer(ids, "<u4")) for ids in memory.of(keys)] == [tokens.encode_whole(k[1:] if k[0] == "\0" else k if k[0] == "\n" else " " + k, vocabulary) for k in keys]
    assert "," in asked and len(asked) == len(set(asked))


def test_texts_are_encoded_in_small_portions(vocabulary):
    """Pieces and ids of a portion take many times the room of its texts."""
    texts = pa.array(["word " * 20_000, None] * 50)
    parts = [(len(ends) - 1, at) for at, ids, ends in tokens.encode_texts(texts, vocabulary, 2)]
    assert sum(n for n, _ in parts) == 100 and max(n for n, _ in parts) <= 22


def test_added_tokens_as_the_library_encodes_them(vocabulary):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(vocabulary)
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"one{end}two\n{end}{end}  three ", f"{end[:-1]} no token", "plain text, as ever"]
    for t, ids in zip(texts, batched(texts, vocabulary)):
        assert ids == tokens.encode_whole(t, vocabulary) == fresh.encode(t, add_special_tokens=False).ids
        assert (50256 in ids) == (end in t)


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 59, 60, 61, 5000]:
        for top in [1, 2, 2**15, 2**20, 2**33, 2**60, 2**63]:
            ids = rng.integers(0, top, n, dtype=np.uint64)
            block = simple8b.encode(ids)
            assert (simple8b.decode(block) == ids).all()
    mixed = rng.choice(np.array([0, 1, 7, 2**40, 2**60, 2**63], dtype=np.uint64), 6000)
    block = simple8b.encode(mixed)
    tail = simple8b.decode(block, 2)
    assert 0 < len(tail) < 6000 and (tail == mixed[-len(tail) :]).all() and (simple8b.decode(block) == mixed).all()
    assert len(simple8b.encode(np.zeros(6000, np.uint64))) < 1000
    with pytest.raises(ValueError):
        simple8b.decode(b"nope" + block[4:])


def test_token_files(spark, odd, none, vocabulary):
    path = scratch_path(spark, "t")
    token_files.write_token_files(odd, path, vocabulary)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    at, whole = 0, Counter()
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        at += r["n_tokens"]
        whole[(r["doc_id"], tuple(r["ids"]))] += 1
    assert whole == Counter((i, (*tokens.encode_whole(t or "", vocabulary), 2)) for i, t in ROWS)
    empty = scratch_path(spark, "t")
    token_files.write_token_files(none, empty, vocabulary)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing(spark, odd, none, vocabulary):
    packed = packing.pack(odd, vocabulary).cache()
    got = packed.collect()
    streams, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        streams[r["doc_id"]].append((r["start"], bytes(r["ids"])))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    whole = defaultdict(list)
    for i, t in ROWS:
        whole[i].append(np.array([*tokens.encode_whole(t or "", vocabulary), 0], dtype="<u4").tobytes())
    for i, parts in whole.items():
        assert sum(map(len, parts)) == sum(len(p) for _, p in streams[i])
        if len(parts) == 1:
            assert b"".join(p for _, p in sorted(streams[i])) == parts[0]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= total / 1024 * 1.05 + 1
    made = packing.sequences(packed).collect()
    assert len(made) == len(sequences) and all(len(r["ids"]) == 1024 for r in made)
    assert packing.pack(none, vocabulary).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1025, 400)
    bins, offsets = packing.first_fit_decreasing(sizes, 1024)
    free: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
        if at is None:
            free.append(1024)
            at = len(free) - 1
        assert bins[i] == at and offsets[i] == 1024 - free[at]
        free[at] -= sizes[i]


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").withColumn("held", langid.held_out())
    model = langid.fit(docs.where("not held"))
    held = langid.predict(docs.where("held"), model)
    assert held.where("lang_pred = lang").count() / held.count() > 0.98
    for text in (None, "", " \n", "12345 !!"):
        assert model.predict(text) == ("und", 0.0)
    assert 0 < model.predict("x")[1] <= 1
    got = langid.predict(odd, model)
    assert got.count() == len(ROWS) and got.where("score < 0 or score > 1 or score is null").count() == 0
    untaught = langid.fit(none)
    assert untaught.predict("anything") == ("und", 0.0) and langid.predict(none, model).count() == 0


def words_of(text):
    return [w.lower() for w in regex.findall(r"\p{L}+", text.lower())] if text else []


def marked_grams(word, n):
    m = word if n == 1 else f"<{word}>"
    return [m[i : i + n] for i in range(len(m) - n + 1)]


LABELLED = [(0, "Ab ab c", "x"), (1, "abc, AB 12 quick", "x"), (2, "b b quack", "y"), (3, None, "y"), (4, "zz", None), (5, "é", "y")]


def brute_judge(text):
    """Word-first backoff from plain counts of ``LABELLED``."""
    counts = {lang: Counter(w for _, t, x in LABELLED if t and x == lang for w in words_of(t)) for lang in "xy"}
    grams = {(lang, n): Counter() for lang in "xy" for n in range(1, 6)}
    for lang, words in counts.items():
        for w, k in words.items():
            for n in range(1, 6):
                for g in marked_grams(w, n):
                    grams[lang, n][g] += k

    def score(c, key):
        return np.log10(c[key] / c.total()) if key in c else -7.0

    def word_scores(w):
        if any(w in c for c in counts.values()):
            return [score(counts[lang], w) for lang in "xy"]
        for n in range(5, 0, -1):
            known = [g for g in marked_grams(w, n) if any(g in grams[lang, n] for lang in "xy")]
            if known:
                return [np.mean([score(grams[lang, n], g) for g in known]) for lang in "xy"]
        return [-7.0, -7.0]

    words = words_of(text)
    if not words:
        return "und", 0.0, -7.0
    mean = np.mean([word_scores(w) for w in words], axis=0)
    best = int(np.argmax(mean))
    return "xy"[best], 1 / (10 ** ((mean - mean[best]) * len(words) ** 0.5)).sum(), mean[best]


@pytest.mark.parametrize("portion", [4_000_000, 10])
def test_language_against_plain_counts(spark, monkeypatch, portion):
    model = langid.fit(spark.createDataFrame(LABELLED, "doc_id long, text string, lang string"), penalty=-7.0)
    assert model.langs == ["x", "y"]
    rng = np.random.default_rng(4)
    texts = [None, "", " ", "12 ½ !", "zz", "quickly quack", "AB ab qqq", "éé zzz", "漢字 b", "a½b"]
    texts += ["".join(rng.choice(list("abcquikzé  ,1"), rng.integers(0, 25))) for _ in range(200)]
    monkeypatch.setattr(tokens, "PORTION", portion)
    got = model.judge(pa.array(texts, pa.string()))
    assert len(got) == len(texts)
    for text, row in zip(texts, got.itertuples(index=False)):
        lang, score, mean = brute_judge(text)
        assert row.score == pytest.approx(score, abs=1e-5) and row.mean == pytest.approx(mean, abs=1e-5)
        assert row.lang_pred == lang or abs(score - 0.5) < 1e-5


def test_the_sample_is_bounded(spark, monkeypatch):
    seen = []
    plain = langid.materialise
    monkeypatch.setattr(langid, "materialise", lambda df, name: seen.append(df) or plain(df, name))

    def fitted(rows, **more):
        seen.clear()
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), **more)
        return {(r["lang"], r["word"]): r["n"] for r in seen[0].collect()}

    letters = [a + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    for ids in (lambda i: None, lambda i: 7, lambda i: i):  # no id, one id for all, ids of their own
        counts = fitted([(ids(i), w, "x") for i, w in enumerate(letters)] + [(ids(i), w, "y") for i, w in enumerate(letters[:30])], max_rows=50)
        assert 20 <= sum(n for (lang, _), n in counts.items() if lang == "x") <= 50
        assert sum(n for (lang, _), n in counts.items() if lang == "y") == 30
    counts = fitted([(1, "same words here", "x")] * 500 + [(i, f"other {w}", "x") for i, w in enumerate(letters)] + [(None, None, "x"), (3, "text", None)], max_rows=2000)
    assert counts["x", "same"] == 1 and counts["x", "other"] == len(letters)


def test_many_languages(spark):
    rows = [(i * 10 + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)}word common{'xyz'[k % 3]} own{chr(97 + i % 26)}{chr(97 + i // 26)}", f"l{i:03}") for i in range(120) for k in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 120 and len(model.words.scores) < 120 * len(model.words.hashes) / 10
    assert [model.predict(f"own{chr(97 + i % 26)}{chr(97 + i // 26)} commonx")[0] for i in (0, 50, 119)] == ["l000", "l050", "l119"]


def test_clean_short_documents_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, small)
    letters = docs.where(F.col("text").rlike(r"\p{L}"))
    assert kept.count() == letters.count() > 0


def test_pipeline_stages(spark, odd, none, small):
    for docs in (odd, none):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, small).cache()
            assert kept.columns == odd.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, kept, small).count() >= kept.count() > -1
    langs = corpus_pipeline.language(spark, odd, small)
    assert {r["doc_id"] for r in langs.where("text is null or doc_id in (2, 3, 9)").collect()} == set()
    near = corpus_pipeline.near_copies(spark, odd, small)
    smallest = {c for (i, _, c) in brute_components(ROWS) if i is not None}
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == smallest


def test_pipeline_mixture_and_packing(spark, odd, small, vocabulary):
    copies = defaultdict(int)
    for r in mixing.mix(odd).collect():
        key = (r["doc_id"], r["size"])
        copies[key] = max(copies[key], r["copies"])
    rows = Counter(tuple(r) for r in corpus_pipeline.mixture(spark, odd, small).collect())
    want = Counter()
    for r in odd_rows():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        want[tuple(r)] += copies[r[0], n]
    assert rows == +want

    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces, filled = defaultdict(list), Counter()
    for r in corpus_pipeline.packed(spark, docs, small).collect():
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024 and set(pieces) == {r["doc_id"] for r in docs.collect()}
    for r in docs.collect():
        ids = np.array([*tokens.encode_whole(r["text"] or "", vocabulary), 0], dtype="<u4")
        at = 0
        for piece in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert piece["start"] == at and piece["doc_tokens"] == len(ids)
            assert piece["ids_crc32"] == zlib.crc32(ids[at : at + piece["length"]].tobytes())
            at += piece["length"]
        assert at == len(ids)


def test_pipeline_runs(spark, small):
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.count() > 0 and pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
