"""How many texts go to a worker, and through it, at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import langid, token_files, tokens
from tidegauge.llm.queries import vocabulary


def test_pipeline_sends_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 300, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), "id"), 10_000).alias("text"))
    try:
        corpus_pipeline.in_small_batches(spark)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]})

        seen = docs.mapInArrow(sizes, "n long, rows long").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["rows"] for r in seen) == 300
    assert max(r["n"] for r in seen) <= 2 * corpus_pipeline.BATCH_BYTES  # all in one before: 24 MB


def test_token_files_encode_a_portion_at_once():
    texts = [f"some words, {i} and \u00e4hnliche (w\u00f6rter) of text{i}; " * 2000 for i in range(40)] + [None, ""]
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(42)), "tag": [0] * 42, "text": pa.array(texts, pa.string())})
    assert rows.nbytes > 1_000_000
    out = list(token_files._encoded(vocabulary(), 2, [])(iter([rows])))
    assert len(out) == -(-rows.column("text").nbytes // tokens.PORTION)  # four times as many before
    kind = tokens.id_type(vocabulary())
    ids = [memoryview(x).cast("H" if kind == "<u2" else "I").tolist() for b in out for x in b.column("ids").to_pylist()]
    for i in (0, 7, 39, 40, 41):
        assert ids[i] == [*tokens.encode_whole(texts[i] or "", vocabulary()), 2]


def test_token_files_remember_more_pieces_than_packing():
    """A corpus of many rare words is not learned anew with every portion, where a worker has the room."""
    words = [f"qu{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}x" for i in range(300_000)]
    texts = pa.array([" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)])
    taught = []
    for share in (1, 4):
        tokens.forget()
        memory = tokens._memory(vocabulary())
        learned, learn = [], memory.learn
        memory.learn = lambda key: learned.append(key) or learn(key)
        got = [np.concatenate([ids for _, ids, _ in tokens.encode_texts(texts, vocabulary(), 2, share)]) for _ in range(2)]
        assert (got[0] == got[1]).all()
        taught.append(len(learned) / 300_000)
    assert taught[0] < 1.1 < taught[1]  # packing's share of room was all there was: both above
    tokens.forget()
    assert not tokens._memory.cache_info().currsize


def test_languages_are_judged_in_small_portions(monkeypatch):
    words = langid.Table.of_counts(pa.table({"lang": ["de", "en"], "key": ["und", "and"], "n": [1, 1]}), ["de", "en"], langid.word_hashes)
    model = langid.Model(["de", "en"], words, [langid.Table.empty()] * langid.LONGEST, -8.0)
    seen, real = [], langid.words_of
    monkeypatch.setattr(langid, "words_of", lambda part: seen.append(part.nbytes) or real(part))
    got = model.judge(pa.array(["and so on " * 20_000, "und so " * 20_000] * 10))
    assert got["lang_pred"].tolist() == ["en", "de"] * 10
    assert max(seen) < 1.1e6  # 3.4 MB at once before
