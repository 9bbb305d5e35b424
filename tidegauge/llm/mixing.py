"""Mixing sources to target token weights by entropy balancing.

Document rates minimise the relative entropy to one copy each, subject to one
token constraint per source and to 0 <= rate <= ``cap``.  The solution is an
exponential tilt of the document's size, ``rate = min(cap, exp(lam * size /
mean size))`` with one multiplier per source; Newton steps on the convex dual
find the multipliers.  Every step is one distributed aggregation over the
table of (source, size, documents), and only its one row per source reaches the
driver, together with the targets, which are configuration of the same length.

Rates are rounded into copies so that the tokens taken stay near the target:
per source, sizes are visited from large to small and each size gets the whole
number of extra copies that best repays the error so far; what error is left
is repaired by trading single copies between sizes.  Which documents of
a size get them is decided by a hash of their id.  Every (source, size) is cut
by that hash into sub-groups of about ``SUB`` rows at most, which share its extra
copies by running totals of their counts, over blocks of ``SUB`` sub-groups first
and then within each; so no step brings the rows of a size together, however
many documents share it.  A source's sizes are one group when rates are rounded:
as many rows as it has distinct sizes.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, the last; sources without words have target 0; rows with
the same id are ranked arbitrarily but only among equal sizes; very long texts
are counted whole; multipliers that do not settle raise an error; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window

from tidegauge.sources.scratch import materialise

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

SUB = 256
LIMIT = 500.0


def word_count(text_col: str) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Share all tokens by weight; what lies above ``cap`` times a source's size is reshared."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in over]
    return target


def _solve(hist: DataFrame, goals: dict[int, tuple[float, float]], cap: float, steps: int, tolerance: float) -> dict[int, float]:
    """Multiplier per source; ``goals`` is source -> (target, mean size)."""
    lam = {k: LIMIT if t >= cap * n else 0.0 for k, (t, n, _) in goals.items()}
    low, high = dict.fromkeys(lam, -LIMIT), dict.fromkeys(lam, LIMIT)
    todo = {k for k, (t, n, _) in goals.items() if 0 < t < cap * n}
    for k, (t, _, _) in goals.items():
        if t <= 0:
            lam[k] = -LIMIT
    for _ in range(steps):
        if not todo:
            break
        by = F.create_map(*[x for k in sorted(todo) for x in (F.lit(k), F.lit(lam[k] / goals[k][2]))])
        tilt = F.exp(F.least(by[F.col("src")] * F.col("size"), F.lit(math.log(cap))))
        mass = F.col("size") * F.col("n")
        slope = F.when(tilt < cap, mass * tilt * F.col("size")).otherwise(0.0)
        # decimal sums do not depend on the order of tasks, so reruns agree
        f, d = (F.sum(x.cast("decimal(28,6)")).cast("double") for x in (mass * tilt, slope))
        sums = hist.where(F.col("src").isin(sorted(todo))).groupBy("src").agg(f.alias("f"), d.alias("d"))
        for r in sums.collect():  # one row per source
            k, (target, _, mean) = r["src"], goals[r["src"]]
            gap = r["f"] - target
            if abs(gap) <= tolerance * target:
                todo.discard(k)
                continue
            if gap > 0:
                high[k] = lam[k]
            else:
                low[k] = lam[k]
            newton = lam[k] - gap / (r["d"] / mean) if r["d"] > 0 else math.inf
            lam[k] = newton if low[k] < newton < high[k] else (low[k] + high[k]) / 2
    if todo:
        raise RuntimeError(f"multipliers of {len(todo)} sources did not settle in {steps} steps")
    return lam


def _repair(size: np.ndarray, n: np.ndarray, base: np.ndarray, extra: np.ndarray, error: float, cap: float) -> None:
    """Trade a copy of one size for one of another while that brings the tokens nearer to the target."""
    for _ in range(8):
        more = np.flatnonzero((size > 0) & (extra < n) & (base < cap))
        less = np.flatnonzero((size > 0) & (extra > 0))
        less = less[np.argsort(size[less], kind="stable")]
        gain, loss = np.r_[0.0, size[more]], np.r_[0.0, size[less]]
        at = np.searchsorted(loss, gain - error)
        near = np.stack([np.clip(at - 1, 0, len(loss) - 1), np.clip(at, 0, len(loss) - 1)])
        left = np.abs(error - gain + loss[near])
        side, i = np.unravel_index(np.argmin(left), left.shape)
        if left[side, i] >= abs(error):
            return
        j = near[side, i]
        error += loss[j] - gain[i]
        if i:
            extra[more[i - 1]] += 1
        if j:
            extra[less[j - 1]] -= 1


def _round(cap: float, lam: dict[int, float], goals: dict[int, tuple[float, float, float]]):
    """Whole copies for each (source, size): ``base`` for all of its documents, ``extra`` of them get one more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        k = int(pdf["src"].iloc[0])
        target, _, mean = goals[k]
        size, n = pdf["size"].to_numpy(np.float64), pdf["n"].to_numpy(np.float64)
        rate = np.minimum(cap, np.exp(np.minimum(lam[k] * size / mean, math.log(cap) + 1e-12)))
        rate[size == 0] = 0.0
        scale = target / max(1e-300, float((rate * size * n).sum()))
        rate = np.minimum(cap, rate * scale)
        base = np.floor(rate + 1e-12)
        extra, error = np.zeros(len(n)), 0.0
        for i in range(len(n)):
            if size[i] == 0:
                continue
            wish = (rate[i] - base[i]) * n[i]
            extra[i] = min(max(round(wish + error / size[i]), 0.0), n[i] if base[i] < cap else 0.0)
            error += (wish - extra[i]) * size[i]
        _repair(size, n, base, extra, error, cap)
        return pd.DataFrame({"src": pdf["src"], "size": pdf["size"], "base": base.astype("int64"), "extra": extra.astype("int64"), "n": pdf["n"]})

    return run


def mix(
    docs: DataFrame,
    weight_of: Callable[[int], float] = lambda i: 1.0 + i % 3,
    cap: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    steps: int = 200,
    tolerance: float = 1e-6,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies.

    ``weight_of`` maps the rank of a source (by code point, null last) to its weight.
    """
    spark = docs.sparkSession
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row per source
    totals.sort(key=lambda r: (r["source"] is None, r["source"]))
    if not totals:
        empty = "size long, source_size long, target double, taken long, copies long"
        return spark.createDataFrame([], f"{id_col} {rows.schema['id'].dataType.simpleString()}, {empty}")
    target = source_targets([r["size"] for r in totals], [weight_of(i) for i in range(len(totals))], cap)
    goals = {i: (target[i], float(r["size"]), max(1.0, r["size"] / r["n"])) for i, r in enumerate(totals)}
    sources = spark.createDataFrame(
        [(r["source"], i, r["size"], target[i]) for i, r in enumerate(totals)], "source string, src int, source_size long, target double"
    )
    # as many rows as the configuration has weights
    rows = rows.withColumnRenamed("source", "_s").join(F.broadcast(sources), F.col("_s").eqNullSafe(F.col("source"))).drop("_s", "source")
    hist = materialise(rows.groupBy("src", "size").agg(F.count("*").alias("n")), "mix-histogram")
    lam = _solve(hist, goals, cap, steps, tolerance)
    cells = hist.groupBy("src").applyInPandas(_round(cap, lam, goals), "src int, size long, base long, extra long, n long")
    return _dealt(rows, materialise(cells, "mix-cells"), id_col)


def _dealt(rows: DataFrame, cells: DataFrame, id_col: str) -> DataFrame:
    """Copies of each row: the ``base`` of its (source, size), and one more for ``extra`` of its ``n`` rows."""
    total = cells.agg(F.sum("n")).first()[0] or 0
    subs = max(1, -(-total // SUB))  # sub-groups of a size that every row has
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(subs)))
    each = rows.groupBy("src", "size", "sub").agg(F.count("*").alias("k")).withColumn("block", F.floor(F.col("sub") / SUB))
    blocks = each.groupBy("src", "size", "block").agg(F.sum("k").alias("in_block")).join(cells, ["src", "size"])
    until = F.sum("in_block").over(Window.partitionBy("src", "size").orderBy("block"))
    blocks = blocks.withColumn("before", until - F.col("in_block")).drop("in_block")
    within = F.sum("k").over(Window.partitionBy("src", "size", "block").orderBy("sub"))
    each = each.join(blocks, ["src", "size", "block"]).withColumn("upto", F.col("before") + within)
    # decimals, for products of two counts may not fit a long
    share = lambda c: F.floor(c.cast("decimal(20,0)") * F.col("extra") / F.col("n")).cast("long")
    quota = share(F.col("upto")) - share(F.col("upto") - F.col("k"))
    plan = each.select("src", "size", "sub", "base", quota.alias("quota"))
    rank = F.row_number().over(Window.partitionBy("src", "size", "sub").orderBy(F.xxhash64("id"), "id"))
    placed = rows.join(plan, ["src", "size", "sub"]).withColumn("copies", F.col("base") + (rank <= F.col("quota")).cast("long"))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
