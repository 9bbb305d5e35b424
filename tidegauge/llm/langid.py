"""Language identification by word-first backoff.

A document's score for a language is the mean over its words of a word score.
A word of the vocabulary scores its log frequency in that language.  A word
that no language knows falls back to the longest character n-grams of which
any language knows one, and scores the mean log frequency of those n-grams;
failing that, shorter ones, down to single letters.  What a language has not
seen scores ``penalty``.

The score of a judgement, 0 to 1, is the winner's share of all languages'
likelihoods, each tempered: ten to the power of its mean word score times the
square root of the number of words, since words of a text are not independent.

The model is fitted on at most ``max_rows`` labelled rows per language: those
whose id and text together have the least hashes, where rows that repeat both
count as one.  It holds every word and n-gram of them, each with the languages
that know it only, so its size, and that of its broadcast, follows the distinct
words and n-grams of those rows, not the table and not the number of languages.
Word and n-gram counts are distributed aggregations.

Defined cases: null text and text without a letter give ``und`` with score 0;
so does every text if there is no labelled row; ties go to the language first
by code point; rows are judged one by one and whole, however long, so repeats
agree; an empty table gives an empty result; extra columns pass through
untouched.  In a fit, rows without an id are drawn by their text, rows that share an
id each by their own, and rows without text or language are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegauge.llm.tokens import forget, give_back, portions
from tidegauge.sources.scratch import discard, materialise

UNKNOWN = "und"
LONGEST = 5
#: Texts are judged a quarter of a portion at a time: words, n-grams and scores take many times their room.
SHARE = 4
_MUL, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters of all texts, in lower case, and how many each text has."""
    letters = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    lists = pc.split_pattern(pc.utf8_trim(letters, " "), " ")
    words = lists.flatten()
    empty = pc.equal(letters, "").to_numpy(zero_copy_only=False) | pc.equal(letters, " ").to_numpy(zero_copy_only=False)
    return words.filter(pc.not_equal(words, "")), np.where(empty, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring code points."""
    m = len(points) - n + 1
    out = np.zeros(max(0, m), dtype=np.uint64)
    for k in range(n if m > 0 else 0):
        out = (out ^ points[k : k + m] ^ (out >> _SHIFT)) * _MUL
    return out ^ (out >> _SHIFT)


class Table:
    """Sorted hashes of keys and, for each, the languages that know it with their scores, one key after the other."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, langs: np.ndarray, scores: np.ndarray):
        self.hashes, self.starts, self.langs, self.scores = hashes, starts, langs, scores

    @classmethod
    def empty(cls) -> Table:
        return cls(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))

    @classmethod
    def of_counts(cls, counts: pa.Table, langs: list[str], hashed: Callable[[list[str]], np.ndarray]) -> Table:
        """From rows (lang, key, n): log10 of relative frequencies."""
        if not counts.num_rows:
            return cls.empty()
        keys = counts["key"].combine_chunks().dictionary_encode()
        lang = np.searchsorted(np.array(langs, dtype=object), counts["lang"].to_numpy())
        n = counts["n"].to_numpy().astype(np.float64)
        scores = np.log10(n / np.bincount(lang, n, len(langs))[lang]).astype(np.float32)
        hashes = hashed(keys.dictionary.to_pylist())
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        at = place[keys.indices.to_numpy()]
        rows = np.argsort(at, kind="stable")
        return cls(hashes[order], np.r_[0, np.cumsum(np.bincount(at, minlength=len(order)))], lang[rows].astype(np.int32), scores[rows])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes, and which of them are known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def sums(self, at: np.ndarray, owner: np.ndarray, owners: int, langs: int, penalty: float) -> np.ndarray:
        """Scores of the keys at these places added up per owner and language; what a language has not seen scores ``penalty``."""
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        each = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        known = np.bincount(np.repeat(owner, sizes) * langs + self.langs[each], self.scores[each] - penalty, owners * langs)
        return known.reshape(owners, langs) + penalty * np.bincount(owner, minlength=owners)[:, None]


class Model:
    """Per-language scores of words and n-grams."""

    def __init__(self, langs: list[str], words: Table, grams: list[Table], penalty: float):
        self.langs, self.words, self.grams, self.penalty = langs, words, grams, penalty

    def unseen(self, words: list[str]) -> np.ndarray:
        """Backed-off scores of words outside the vocabulary."""
        out = np.full((len(words), len(self.langs)), self.penalty)
        todo = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            mark = ("", "") if n == 1 else ("<", ">")
            some = [f"{mark[0]}{words[i]}{mark[1]}" for i in todo.tolist()]
            sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
            owner = np.repeat(np.arange(len(some)), sizes)
            ends = np.repeat(np.cumsum(sizes), sizes)
            hashes = gram_hashes(_points("".join(some)), n)
            inside = np.arange(len(hashes)) + n <= ends[: len(hashes)]
            at, known = self.grams[n - 1].find(hashes[inside])
            owner, at = owner[: len(hashes)][inside][known], at[known]
            hits = np.bincount(owner, minlength=len(some))
            done = hits > 0
            out[todo[done]] = (self.grams[n - 1].sums(at, owner, len(some), len(self.langs), self.penalty)[done]) / hits[done][:, None]
            todo = todo[~done]
            if not len(todo):
                break
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words."""
        at, known = self.words.find(word_hashes(words))
        out = np.empty((len(words), len(self.langs)))
        out[known] = self.words.sums(at[known], np.arange(known.sum()), int(known.sum()), len(self.langs), self.penalty)
        out[~known] = self.unseen([words[i] for i in np.flatnonzero(~known).tolist()])
        return out

    def judge(self, texts: pa.Array) -> pd.DataFrame:
        """Of each text: lang_pred, score, and the mean word score behind it (``penalty`` if nothing is known of it)."""
        found = [pd.DataFrame({"lang_pred": pd.Series(dtype=object), "score": pd.Series(dtype=float), "mean": pd.Series(dtype=float)})]
        for _, part in portions(texts, SHARE):
            words, n = words_of(part)
            if not self.langs:
                n[:] = 0
            coded = words.dictionary_encode()
            code, owner = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            each = self.scores(coded.dictionary.to_numpy(zero_copy_only=False).tolist()) if self.langs else np.zeros((0, 0))
            sums = [np.bincount(owner, each[code, lang], len(n)) for lang in range(len(self.langs))]
            mean = np.array(sums).T / np.maximum(n, 1)[:, None] if sums else np.zeros((len(n), 1))
            best = mean.argmax(axis=1)
            top = mean[np.arange(len(n)), best]
            score = 1 / (10.0 ** ((mean - top[:, None]) * np.sqrt(n)[:, None])).sum(axis=1)
            names = np.array([*self.langs, UNKNOWN], dtype=object)
            found.append(pd.DataFrame({"lang_pred": names[np.where(n > 0, best, len(names) - 1)], "score": np.where(n > 0, score, 0.0), "mean": np.where(n > 0, top, self.penalty)}))
        return pd.concat(found[1:] or found, ignore_index=True)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score of one text."""
        row = self.judge(pa.array([text], pa.string())).iloc[0]
        return row["lang_pred"], float(row["score"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts per language, a portion of texts at a time."""
    for batch in batches:
        for at, part in portions(batch.column("text")):
            langs = batch.column("lang").slice(at, len(part))
            for lang in pc.unique(langs):
                counted = words_of(part.filter(pc.equal(langs, lang)))[0].value_counts()
                words = counted.field("values").cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(words), pa.string()), words, counted.field("counts")], names=["lang", "word", "n"])


def _grams(word: Column, n: int) -> Column:
    """N-grams of a word with its ends marked (single letters carry no marks), as an array of (size, key)."""
    marked = word if n == 1 else F.concat(F.lit("<"), word, F.lit(">"))
    last = F.length(marked) - n + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.struct(F.lit(n).alias("size"), F.substring(marked, i, F.lit(n)).alias("key")))
    return F.when(last >= 1, each).otherwise(F.slice(each, 1, 0))


def fit(labelled: DataFrame, id_col: str = "doc_id", max_rows: int = 1000, penalty: float = -8.0) -> Model:
    """Fit on rows of ``labelled`` (id, text, lang) whose text and lang are not null."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], Table.empty(), [Table.empty()] * LONGEST, penalty)
    # a share of each language's rows that leaves about max_rows of them; of these one of each id and text, and no more than max_rows
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(max_rows / r["count"]))])
    rows = rows.select("lang", "text", F.xxhash64(F.col(id_col), F.col("text")).alias("draw"))
    drawn = rows.where(F.pmod("draw", F.lit(1_000_000)) / 1_000_000.0 < share[F.col("lang")])
    once = drawn.groupBy("lang", "draw").agg(F.max("text").alias("text"))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))  # about max_rows rows a language
    sample = once.withColumn("place", least).where(F.col("place") <= max_rows).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "word-counts")
    words = counts.select("lang", F.col("word").alias("key"), "n").toArrow()
    some = F.flatten(F.array(*[_grams(F.col("word"), n) for n in range(1, LONGEST + 1)]))
    grams = counts.select("lang", "n", F.explode(some).alias("g")).groupBy("lang", "g.size", "g.key").agg(F.sum("n").alias("n")).toArrow()
    size = grams["size"].to_numpy()

    def table(n: int) -> Table:
        # keys have n code points each: of their joined text every n-th run is one
        return Table.of_counts(grams.filter(pa.array(size == n)), langs, lambda keys: gram_hashes(_points("".join(keys)), n)[::n])

    model = Model(langs, Table.of_counts(words, langs, word_hashes), [table(n) for n in range(1, LONGEST + 1)], penalty)
    del words, grams, size
    give_back()
    discard(counts)
    return model


def judge(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function of a text column: struct of ``lang_pred``, ``score`` and ``explained`` (whether anything of the text is known)."""
    shared, penalty = spark.sparkContext.broadcast(model), model.penalty  # bounded by the model's sample

    @F.pandas_udf("lang_pred string, score double, explained boolean")
    def judged(texts: pd.Series) -> pd.DataFrame:
        forget()
        out = shared.value.judge(pa.Array.from_pandas(texts, type=pa.string()))
        return pd.DataFrame({"lang_pred": out["lang_pred"], "score": out["score"], "explained": out["mean"] > penalty})

    return judged


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replacing columns of these names); only the text is looked at."""
    judged = docs.select(F.struct(*docs.columns).alias("row"), judge(docs.sparkSession, model)(F.col(text_col)).alias("judged"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return judged.select(*kept, "judged.lang_pred", "judged.score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of the fit: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
