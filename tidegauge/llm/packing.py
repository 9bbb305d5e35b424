"""Packing documents into sequences: first-fit decreasing on a tournament tree.

Documents are cut at multiples of the sequence length, so all but a document's
last piece fill a sequence alone.  Last pieces are dealt at random (by a hash)
into groups of about ``group_pieces``; each group is packed on its own by
first-fit decreasing, where a tournament tree over the free space of the bins
finds the first bin that fits in logarithmic time.  Groups are independent, so
the work spreads over any number of tasks, and only lengths are shuffled.

Defined cases: null and empty texts are one piece with the end id; rows without
an id are dealt by their place; rows repeating an id are packed each on its
own, with a ``part`` that tells them apart; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm import tokens
from tidegauge.sources.scratch import materialise

#: Sequences of one group are numbered within this range.
GROUP_RANGE = 1 << 24


class BinTree:
    """Tournament tree over bins; each inner node holds the largest free space below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [room] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin that has room; (bin, free space before)."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        before = free[at]
        free[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return bin_, before


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; ties go in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree = BinTree(max(1, len(sizes)), room)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in order.tolist():
        bins[i], before = tree.take(int(sizes[i]))
        offsets[i] = room - before
    return bins, offsets


PIECES = "doc_id long, part long, start long, length long, doc_tokens long, ids_crc32 long, deal long"


def _pieces(vocabulary: str, end_id: int, room: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc = batch.column("doc_id")
            for at, ids, ends in tokens.encode_texts(batch.column("text"), vocabulary, end_id):
                n = np.diff(ends)
                pieces = -(-n // room)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * room
                length = np.minimum(room, n[row] - start)
                begin = ends[row] + start
                view = memoryview(ids.astype("<u4").tobytes())
                cut = [view[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
                ids_of, part = doc.slice(at, len(n)).take(pa.array(row)), pa.array(place + row)
                columns = [ids_of, part, pa.array(start), pa.array(length), pa.array(n[row]), pa.array(map(zlib.crc32, cut), pa.int64()), pc.coalesce(ids_of, part)]
                columns += [pa.array(map(bytes, cut), pa.binary())] * with_ids
                names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=names)
                place += len(n)

    return run


def _pack(room: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "deal", "start", "part"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), room)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * GROUP_RANGE + bins, offset=offsets)[["part", "start", "sequence_id", "offset"]]

    return run


def cut(docs: DataFrame, vocabulary: str, end_id: int = 0, room: int = 1024, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text, with their packed ids unless refused."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(vocabulary, end_id, room, with_ids), PIECES + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    room: int = 1024,
    group_pieces: int = 4096,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its packed ids)."""
    pieces = materialise(cut(docs, vocabulary, end_id, room, with_ids, id_col, text_col), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # by its place, which no two rows share: rows that repeat an id are dealt apart
    grp = F.pmod(F.xxhash64("part", "start", F.lit(11)), F.lit(groups))
    narrow = pieces.select("part", "start", "length", "deal", grp.alias("grp"))
    placed = narrow.groupBy("grp").applyInPandas(_pack(room), "part long, start long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return pieces.join(placed, ["part", "start"]).select(columns)


def sequences(packed: DataFrame, pad_id: int = 0, room: int = 1024) -> DataFrame:
    """The padded sequences themselves: sequence_id, ids (array of ``room`` ids), n_ids."""

    @F.pandas_udf("array<int>")
    def join(parts: pd.Series) -> pd.Series:
        out = []
        for group in parts:
            ids = np.frombuffer(b"".join(r["ids"] for r in group), dtype="<u4").astype(np.int32)
            out.append(np.pad(ids, (0, room - len(ids)), constant_values=pad_id))
        return pd.Series(out)

    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
    return rows.select("sequence_id", join("parts").alias("ids"), "n_ids")
