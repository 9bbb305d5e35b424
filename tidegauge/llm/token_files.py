"""Token-id files: every document's ids in ascending id order, Simple-8b coded.

Texts are encoded where they are read, so only ids travel: packed in the
narrowest integers that hold the vocabulary, they go to the shard of their
document id and are sorted there.  Shards are ranges of document ids, in order,
with bounds at quantiles of the ids.

The file format is a folder of Parquet part files, so that Spark's commit
protocol covers lost executors and any store Spark can write to will do.  Rows
are blocks: shard and block number, the ids before it in its shard, the
documents inside (ids and how many token ids each has) and the coded payload.
Blocks hold whole documents, up to about ``BLOCK_IDS`` ids.  Reading needs no
order of files and no shuffle: a block tells its place in its shard, and only
one row per shard is summed up on the driver.

Defined cases: null and empty texts hold the end id only; rows without an id
come first; rows repeating an id are neighbours, in the order of their text
hash; very long texts are blocks of their own; an empty table makes an empty
file; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import simple8b, tokens

BLOCK_IDS = 1 << 16
ENCODED = "shard int, doc_id long, tag long, ids binary"
BLOCKS = "shard int, block int, first long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, payload binary"


def _encoded(vocabulary: str, end_id: int, bounds: list[int]):
    """Every document's ids with its shard; documents without an id belong to the first."""
    edges = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(tokens.id_type(vocabulary))
        kind = kind if end_id < 1 << 8 * kind.itemsize else np.dtype("<u4")
        for batch in batches:
            doc, tag = batch.column("doc_id"), batch.column("tag")
            shard = np.searchsorted(edges, doc.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "left").astype(np.int32)
            for at, ids, ends in tokens.encode_texts(batch.column("text"), vocabulary, end_id, share=1):
                n = len(ends) - 1
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends * kind.itemsize), pa.py_buffer(ids.astype(kind))])
                columns = [pa.array(shard[at : at + n]), doc.slice(at, n), tag.slice(at, n), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "tag", "ids"])

    return run


def _blocks(vocabulary: str, end_id: int):
    """Blocks of one shard, whose documents come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(tokens.id_type(vocabulary))
        kind = kind if end_id < 1 << 8 * kind.itemsize else np.dtype("<u4")
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])
        doc_ids, lengths, held, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"shard": shard, "block": number, "first": first, "doc_ids": doc_ids, "lengths": lengths, "n_ids": size, "payload": simple8b.encode(ids)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(packed.as_buffer(), dtype=kind)
                doc_ids.append(doc_id)
                lengths.append(len(ids))
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    number, first = number + 1, first + size
                    doc_ids, lengths, held, size = [], [], [], 0
        if held:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text of ``docs`` into a token-id file at ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    quantiles = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts) if parts > 1 else F.lit(None)
    bounds = rows.agg(quantiles.alias("q")).first()["q"] or []  # one number per shard
    encoded = rows.mapInArrow(_encoded(vocabulary, end_id, bounds), ENCODED)
    ordered = encoded.repartitionById(parts, F.col("shard")).sortWithinPartitions("doc_id", "tag").select("doc_id", "ids")
    ordered.mapInArrow(_blocks(vocabulary, end_id), BLOCKS).write.parquet(path)


def _documents(payloads: bool, bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, payload = (batch.column(c)[i].as_py() for c in ("shard", "first", "payload"))
                ids = simple8b.decode(payload).astype("<u4")
                lengths = batch.column("lengths")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = {"doc_id": batch.column("doc_ids")[i].values, "start": pa.array(starts + (bases[shard] + first)), "n_tokens": pa.array(lengths)}
                if payloads:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns | {"ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, its ids unless refused, and their crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row per shard
    bases, base = {}, 0
    for r in sizes:
        bases[r["shard"]] = base
        base += r["n"]
    schema = "doc_id long, start long, n_tokens long, " + ("ids array<bigint>, " if with_ids else "") + "ids_crc32 long"
    return blocks.select("shard", "first", "doc_ids", "lengths", "payload").mapInArrow(_documents(with_ids, bases), schema)
