"""Corpus-wide line deduplication with DataFrame functions only.

Lines are exploded under a normalised key, the key is hashed, distinct documents are counted for each hash, and the
lines of the frequent hashes are dropped; documents are reassembled by line position. Only hashes and positions are
shuffled for the count; a document's text moves once, to meet its dropped positions. The frequent hashes are written and
broadcast if they are small, so that the places of a line that a third of all documents share never meet in one task;
beyond that size places and frequent hashes are joined under salted keys, with the same result.

Cases: a document is a distinct (doc_id, text), so a repeated row counts once and each repetition gets the same
result; a null or empty text is one empty line; very long texts are split whole; a null doc_id is a document like any
other; keys shorter than min_chars are never dropped; a line exactly min_docs documents hold is dropped; an empty table
gives an empty result; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize

#: Bytes of frequent hashes that are broadcast, and rows that each is copied to beyond.
LIMIT, SALTS = 32 << 20, 16
_SPACE = " \t\n\x0b\x0c\r"


def key_hashes(lines: Column, min_chars: int) -> Column:
    """128-bit hashes of the lines' keys (ASCII space stripped at both ends, A-Z lower-cased); null if a key is short."""
    keys = F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(_SPACE))), ascii_lower)
    return F.transform(keys, lambda x: F.when(F.char_length(x) >= min_chars, F.unhex(F.md5(x))))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text and carried (a struct of the other columns) of every row."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    base = docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None)).alias("carried")).withColumn("k", F.xxhash64(F.lit(17), "doc_id", "text"))
    own = base.select("doc_id", "k", key_hashes(lines, min_chars).alias("h"))
    # Rows that repeat a document would count twice: the two digests of a document tell them apart.
    seen = own.select("doc_id", "k", F.explode(F.array_distinct("h")).alias("h")).where("h IS NOT NULL")
    frequent = seen.groupBy("h", "doc_id", "k").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h")
    frequent = materialize(frequent.withColumn("none", F.lit("")), "frequent-lines", rows=docs.count())
    small = broadcast_if_small(frequent, "none", limit)
    places = own.select("doc_id", "k", F.posexplode("h").alias("pos", "h")).where("h IS NOT NULL")
    if small is not frequent:
        places = places.join(small.select("h"), "h", "left_semi")
    else:
        salted = frequent.select("h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        places = places.withColumn("salt", F.pmod(F.xxhash64("k", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi")
    dropped = places.groupBy(F.col("doc_id").alias("d_id"), F.col("k").alias("d_k")).agg(F.collect_set("pos").alias("gone"))
    met = base.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("k") == F.col("d_k")), "left")
    met = met.select("doc_id", "carried", lines.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return met.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n").alias("kept_text"),
        "carried",
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
