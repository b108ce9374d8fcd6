"""Benchmark decontamination with DataFrame functions only.

Every benchmark item becomes its windows of 13 normalised words (a shorter item is one window). The set of their hashes
is broadcast, and so are their anchors: of each window the pair of neighbouring words with the most characters, and its
place in the window. Document words are scanned in place; where a pair is an anchor, the window around it is hashed and
looked up, and each hit is verified against the item's words. Each window holds its anchor, so no occurrence is missed.
At most max_windows windows are broadcast at once, in blocks by hash; a larger benchmark takes a scan for each block, by
the same plan, so results hang on no size and no document word is shuffled.

Cases: null or wordless texts have no words and no hits; very long texts are scanned whole; null and repeated doc_ids
keep their rows (rows of the same doc_id and text get the same result); a null item_id matches but isn't listed; an
item_id that repeats counts once; only A-Z are lower-cased, other letters match as they are; ids may have any type that
casts to a string; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fewer_tasks, keyed, materialize

WINDOW = 13
#: Windows broadcast at once, about 200 bytes each.
MAX_WINDOWS = 250_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def joined(words: Column, start: Column, n: Column) -> Column:
    """n words from the 0-based start as one string."""
    return F.array_join(F.slice(words, start + 1, n), " ")


def pair_key(first: Column, second: Column) -> Column:
    """Hash of two neighbours; of the first alone where there is no second."""
    return F.when(second.isNull(), F.xxhash64(F.lit(1), first)).otherwise(F.xxhash64(F.lit(2), first, second))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, w (words of a window), n (how many), h (its hash), key (hash of its anchor) and o (the anchor's place)."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", "words", F.least(F.lit(window), F.size("words")).alias("n"))
    starts = items.select("item_id", "words", "n", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("s"))
    w = starts.select("item_id", "n", joined(F.col("words"), F.col("s"), F.col("n")).alias("w")).distinct().withColumn("ws", F.split("w", " "))
    length = lambda i: F.char_length(F.get("ws", i)) + F.coalesce(F.char_length(F.get("ws", i + 1)), F.lit(0))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 2, F.lit(0))), lambda i: F.struct(length(i).alias("size"), (-i).alias("o"))))
    w = w.withColumn("o", -best["o"])
    return w.select("item_id", "w", "n", F.xxhash64("w").alias("h"), pair_key(F.get("ws", F.col("o")), F.get("ws", F.col("o") + 1)).alias("key"), "o")


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id, k, n_words; verified hits with doc_id, k, item_id, s, n)."""
    wins = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    words = fewer_tasks(keyed(docs), docs.count()).select("doc_id", "k", words_of(F.col("text")).alias("words"))
    # A first row without a word stands for the document itself.
    rows = words.select("doc_id", "k", "words", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("words"))).alias("i", "word"))
    rows = rows.withColumns({"i": F.col("i") - 1, "after": F.get("words", F.col("i"))})
    n_windows, least = wins.agg(F.count(F.lit(1)), F.min("n")).first()
    n_blocks = max(1, -(-n_windows // max(1, max_windows)))
    parts = []
    for b in range(n_blocks):
        own = wins.where(F.pmod(F.xxhash64("w", F.lit(b"block")), F.lit(n_blocks)) == b) if n_blocks > 1 else wins
        anchors = F.broadcast(own.select("key", "n", "o").distinct())
        hashes = F.broadcast(own.select(F.col("h").alias("w_h"), F.col("n").alias("w_n"), "w", "item_id"))
        keys = pair_key(F.col("word"), F.col("after"))
        if least == 1:  # an item of one word is met at every word, last or not
            keyed_rows = rows.withColumn("key", F.explode(F.when(F.col("word").isNull() | F.col("after").isNull(), F.array(keys)).otherwise(F.array(keys, pair_key(F.col("word"), F.lit(None).cast("string"))))))
        else:
            keyed_rows = rows.withColumn("key", keys)
        head = F.col("word").isNull()
        some = keyed_rows.withColumn("key", F.when(~head, F.col("key"))).join(anchors, "key", "left")
        start = F.col("i") - F.col("o")
        fits = (start >= 0) & (start + F.col("n") <= F.size("words"))
        some = some.where(head | fits).withColumns({"s": start, "own": joined(F.col("words"), start, F.col("n"))})
        some = some.join(hashes, (F.xxhash64("own") == F.col("w_h")) & (F.col("n") == F.col("w_n")) & (F.col("own") == F.col("w")), "left")
        parts.append(some.where(F.col("w").isNotNull() | (head if not b else F.lit(False))).select("doc_id", "k", F.when(head, F.size("words")).cast("long").alias("n_words"), "item_id", "s", "n"))
    met = materialize(reduce(DataFrame.unionByName, parts), "decontaminate")
    return met.where("n_words IS NOT NULL").select("doc_id", "k", "n_words"), met.where("n_words IS NULL").select("doc_id", "k", "item_id", "s", "n")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, k, n_words, hit (positions of hit words, sorted), items (item_ids as sorted strings) and contaminated."""
    seen, hits = scan(docs, benchmark, window, max_windows)
    hits = hits.select("doc_id", "k", "item_id", F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("pos"))
    met = hits.groupBy(F.col("doc_id").alias("h_id"), F.col("k").alias("h_k")).agg(F.collect_set("pos").alias("hit"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    out = seen.join(met, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("k") == F.col("h_k")), "left")
    out = out.select("doc_id", "k", "n_words", F.sort_array(F.coalesce("hit", F.array().cast("array<int>"))).alias("hit"), F.sort_array(F.coalesce("items", F.array().cast("array<string>"))).alias("items"))
    n_hit = F.size("hit").cast("long")
    return out.select("doc_id", "k", "n_words", "hit", "items", ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(coalesce(t, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bs AS (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(0, len(ws) - least(13, len(ws)) + 1)) AS s FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s + 1 : s + n], ' ') AS w FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT ds.doc_id, bw.item_id, ds.s, ds.n FROM ds JOIN bw ON bw.n = ds.n AND bw.w = array_to_string(ds.ws[ds.s + 1 : ds.s + ds.n], ' ')),
h AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit > 0 AND 20 * h.n_hit >= len(d.ws), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
