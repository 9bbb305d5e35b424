"""Line dedup by range-partitioned hashes, answering with keep bitmaps.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of at least ``min_chars`` code points that occur in at least ``min_docs``
documents keep their lines only in the largest document id that holds them.

Every document first reduces its lines to one row per distinct key.  Those
rows (128-bit hash, document, line numbers) are range-partitioned on (hash,
document descending) and sorted within, so a line that a third of the corpus
holds is spread over many partitions.  Each partition streams its rows in
order and says at once which of them lose their lines: the first document of a
run keeps it, and all later ones lose it as soon as the run has enough
documents.  Only rows of a run that a partition border may cut stay open; at
most two runs per partition can be cut, so a table of that size, broadcast,
settles them.  The outcome per document is a zlib-compressed bitmap (bit set:
line stays), never its text.

Defined cases: null or empty text is one empty line; rows without an id do not
count as documents and lose nothing; rows that repeat an id are one document, of
which each row has a bitmap of its own; long texts are split whole; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegauge.sources.scratch import materialise

#: The code points stripped from both ends of a line.
SPACES = " \t\n\x0b\x0c\r"

KEYS = "h1 long, h2 long, doc long, tag long, at array<int>"


def line_keys(text: str, min_chars: int) -> dict[bytes, list[int]]:
    """Hash of each long enough key of ``text`` -> its line numbers."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split("\n")):
        key = line.strip(SPACES)
        if len(key) >= min_chars:
            found.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(i)
    return found


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.list_(pa.int32()))])
        for batch in batches:
            hashes, doc, tag, at = [], [], [], []
            for d, g, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "text"))):
                for h, lines in line_keys(text or "", min_chars).items():
                    hashes.append(h)
                    doc.append(d)
                    tag.append(g)
                    at.append(lines)
            pair = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(at, pa.list_(pa.int32()))], schema=schema)

    return run


VERDICTS = "doc long, tag long, at array<int>, h1 long, h2 long, n long, first long"


class _Run(NamedTuple):
    """The run of equal hashes that a batch ends in."""

    h1: int
    h2: int
    doc: int  # of its last row
    rank: int  # distinct documents so far
    keeper: int  # of its first row
    leads: bool  # it is the first run of the partition, which may have begun before


def _verdicts(min_docs: int):
    """From rows in order: those that lose their lines; open rows (with their hash); counts of runs at the borders (without a document)."""
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.list_(pa.int32())), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("first", pa.int64())])

    def rows(batch: pa.RecordBatch, open_: bool) -> pa.RecordBatch:
        n = batch.num_rows
        hashes = [batch.column(c) if open_ else pa.nulls(n, pa.int64()) for c in ("h1", "h2")]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc", "tag", "at")], *hashes, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

    def count(run: _Run) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"h1": int(run.h1), "h2": int(run.h2), "n": int(run.rank), "first": int(run.keeper)}], schema=schema)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: _Run | None = None
        held: list[pa.RecordBatch] = []  # rows of the last run that wait for more documents
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in ("h1", "h2", "doc"))
            goes_on = last is not None and (h1[0], h2[0]) == (last.h1, last.h2)
            new_run = np.r_[not goes_on, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_run | np.r_[not goes_on or doc[0] != last.doc, doc[1:] != doc[:-1]]
            starts, run, seen = np.flatnonzero(new_run), np.cumsum(new_run), np.cumsum(new_doc)  # run 0 is the one that goes on
            before = last.rank if goes_on else 0
            rank = seen - np.r_[-before, seen[starts] - 1][run]
            top = np.zeros(len(starts) + 1, dtype=np.int64)
            np.maximum.at(top, run, rank)
            keeper = np.r_[last.keeper if goes_on else 0, doc[starts]]
            leading = 1 if last is None else 0 if goes_on and last.leads else -1
            ends_in = int(run[-1])
            if last is not None and last.leads and not goes_on:
                yield count(last)
            elif -1 < leading < ends_in:
                edge = np.flatnonzero(run == leading)[-1]
                yield count(_Run(h1[edge], h2[edge], doc[edge], top[leading], keeper[leading], True))
            if held and goes_on and top[0] >= min_docs:
                yield from (rows(b, False) for b in held)
            if not goes_on or top[0] >= min_docs or ends_in:
                held = []
            leads, later = run == leading, rank > 1
            enough = top[run] >= min_docs
            if leads.any():
                yield rows(batch.filter(pa.array(leads)), True)
            if (lost := ~leads & later & enough).any():
                yield rows(batch.filter(pa.array(lost)), False)
            if (wait := ~leads & later & ~enough & (run == ends_in)).any():
                held.append(batch.filter(pa.array(wait)))
            last = _Run(h1[-1], h2[-1], doc[-1], rank[-1], keeper[ends_in], ends_in == leading)
        if last is not None:
            yield count(last)
            yield from (rows(b, True) for b in held)

    return stream


def pack_bitmap(n_lines: int, dropped) -> bytes:
    """A compressed bitmap over ``n_lines`` lines with the bits of ``dropped`` cleared."""
    bits = np.ones(n_lines, dtype=np.uint8)
    bits[np.asarray(dropped, dtype=np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def apply_bitmap(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The lines of ``text`` that stay, joined again; lines before; lines dropped."""
    if bitmap is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[: len(lines)].tolist()
    kept = [x for x, keep in zip(lines, bits) if keep]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def _tag(id_col: str, text_col: str):
    return F.xxhash64(F.col(text_col), F.col(id_col))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tag, at) for each document that loses lines, with their numbers; ``tag`` tells apart texts under one id."""
    source = docs.select(F.col(id_col).cast("long").alias("doc"), _tag(id_col, text_col).alias("tag"), F.col(text_col).alias("text"))
    keys = materialise(source.mapInArrow(_keys(min_chars), KEYS), "line-keys").where("doc is not null")
    order = ["h1", "h2", F.desc("doc")]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    verdicts = materialise(ordered.mapInArrow(_verdicts(min_docs), VERDICTS), "line-verdicts")
    cut = verdicts.where("doc is null").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    cut = cut.where(F.col("n") >= min_docs).select("h1", "h2", "first")  # two rows per partition at most
    open_ = verdicts.where("doc is not null and h1 is not null").drop("n", "first").join(F.broadcast(cut), ["h1", "h2"]).where("doc != first")
    lost = verdicts.where("doc is not null and h1 is null").select("doc", "tag", "at").unionByName(open_.select("doc", "tag", "at"))
    return lost.groupBy("doc", "tag").agg(F.flatten(F.collect_list("at")).alias("at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``keep_bitmap`` (null: every line stays); texts are unchanged."""
    lost = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), _tag(id_col, text_col).alias("own"))

    @F.pandas_udf("binary")
    def compress(n: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else pack_bitmap(k, a) for k, a in zip(n, at)], dtype=object)

    # the text is only counted here, for the bitmap's length
    text = F.col(f"row.{text_col}")
    n_lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    joined = rows.join(lost, F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("tag")), "left")
    bitmap = F.when(F.col("at").isNotNull(), compress(F.coalesce(n_lines, F.lit(1)), F.col("at")))
    return joined.select("row.*", bitmap.alias("keep_bitmap"))
