"""Registered queries of the language-model operators: thin digests over them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import ann, exact_dedup, html_text, jaccard, langid, license_scan, line_dedup, merkle, mixing, packing, shard, spelling, token_files
from tidegauge.sources.scratch import scratch_path


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, vocabulary(), end_id=2)
    return token_files.read_token_files(spark, path, with_ids=False)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shard_rows(_table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), end_id=0, with_ids=False)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def digest(texts: pd.Series, bitmaps: pd.Series) -> pd.DataFrame:
        out = []
        for text, bitmap in zip(texts, bitmaps):
            left, lines, dropped = line_dedup.apply_bitmap(text or "", bitmap)
            out.append((lines, dropped, hashlib.sha256(left.encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256"])

    return kept.select("doc_id", digest("text", "keep_bitmap").alias("d")).select("doc_id", "d.*")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.main_text(_table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    values = ["doc_id", "source", "lang", "n_chars"]
    changed = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(changed, merkle.leaf_digest(*map(F.col, values), F.replace("text", F.lit("\n"), F.lit(""))))
    proven = merkle.manifest(docs, [*values, "text"], carry={"tampered": tampered})
    rows = proven.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted_words(_table(spark, sf_dir, "documents"), delete_every=31))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", license_scan.scan(F.col("text")).alias("f"))
    return found.select("doc_id", *[f"f.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


OP7_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

OP9_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT keyed.*, coalesce(doc_id <> keeper, false) AS dropped FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


#: Unsigned crc32 of a list of bytes: {bytes}, with the table made by its rule.
CRC_TABLE = "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)"
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"

_CHANGED = CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")
OP11_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), fields AS (
  SELECT doc_id, source, text, coalesce({_CHANGED} % 2 = 0, false) AS changed,
         concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head
  FROM documents, crc
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN changed AND text IS NOT NULL
              THEN sha256(head || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '')) END AS tampered
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
  SELECT source, 0 AS level, i, leaf AS digest, n FROM placed
  UNION ALL
  SELECT source, level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, i // 3, n
), subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, i, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM upper WHERE n > 1 GROUP BY level, i // 3, n
), levels AS (
  SELECT unnest(range(40)) AS level
), steps AS (
  SELECT p.source, p.i, l.level,
         coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (WHERE s.i < p.i // pow(3, l.level)::BIGINT), '') AS l,
         coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (WHERE s.i > p.i // pow(3, l.level)::BIGINT), '') AS r
  FROM placed p JOIN levels l ON pow(3, l.level) < p.n
  JOIN nodes s ON s.source IS NOT DISTINCT FROM p.source AND s.level = l.level AND s.i // 3 = p.i // pow(3, l.level + 1)::BIGINT
  GROUP BY p.source, p.i, l.level
), upper_steps AS (
  SELECT p.source, l.level,
         coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (WHERE s.i < p.i // pow(3, l.level)::BIGINT), '') AS l,
         coalesce(string_agg(s.digest, '' ORDER BY s.i) FILTER (WHERE s.i > p.i // pow(3, l.level)::BIGINT), '') AS r
  FROM subroots p JOIN levels l ON pow(3, l.level) < p.n
  JOIN upper s ON s.level = l.level AND s.i // 3 = p.i // pow(3, l.level + 1)::BIGINT
  GROUP BY p.source, l.level
), way AS (
  SELECT source, i, list({{'l': l, 'r': r}} ORDER BY level) AS low FROM steps GROUP BY source, i
), upper_way AS (
  SELECT source, list({{'l': l, 'r': r}} ORDER BY level) AS high FROM upper_steps GROUP BY source
), paths AS (
  SELECT p.doc_id, p.leaf, p.tampered, s.subroot, u.digest AS root, list_concat(coalesce(low, []), coalesce(high, [])) AS path
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN upper u ON u.n = 1
  LEFT JOIN way w ON w.source IS NOT DISTINCT FROM p.source AND w.i = p.i LEFT JOIN upper_way x ON x.source IS NOT DISTINCT FROM p.source
), ends AS (
  SELECT *, list_reduce(list_prepend({{'l': coalesce(tampered, leaf), 'r': ''}}, path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM paths
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ends
"""


# UTF-8 bytes of an id, a colon and a word of this alphabet
_PLACE = CRC.format(bytes="flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END))")
OP12_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
), placed AS (
  SELECT run, n, coalesce({_PLACE}, 1) AS h FROM each, crc
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM placed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), skipped AS (
  SELECT word, n, unnest(range(length(word))) AS i FROM words
), gaps AS (
  SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 2) AS s FROM skipped
), splits AS (
  SELECT word, n, substr(word, 1, i) AS p, substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words)
), links AS (
  SELECT a.word AS a, b.word AS b FROM gaps a JOIN gaps b USING (p, s) WHERE a.word <> b.word
  UNION SELECT a.word, b.word FROM gaps a JOIN splits b USING (p, s)
  UNION SELECT b.word, a.word FROM gaps a JOIN splits b USING (p, s)
), best AS (
  SELECT a AS word, count(*) AS n_near, max(w.n) AS best_n, arg_min(b, (-w.n, b)) AS best FROM links JOIN words w ON w.word = b GROUP BY a
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), ways AS (
  SELECT word, word AS place, 0 AS steps FROM formed
  UNION ALL
  SELECT ways.word, form, steps + 1 FROM ways JOIN formed ON formed.word = ways.place WHERE form IS NOT NULL
)
SELECT word, form, arg_max(place, steps) AS root, n, n_near, form_n FROM formed JOIN ways USING (word) GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_files": op2_token_files,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_sharding": op4_sharding,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_mixing": op6_mixing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_packing": op8_packing,
        "op9_line_dedup": op9_line_dedup,
        "op10_html_text": op10_html_text,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_spelling_variants": OP12_SQL}
