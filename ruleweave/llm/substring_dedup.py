"""Removal of repeated passages by Rabin-Karp hashes of every window of words.

Each block of windows hashes every window with a rolling polynomial over 64-bit word hashes. Windows that repeat
within a block are settled there; the first of each is shipped, packed by hash bucket with its document and start. A
bucket counts its hashes over the whole table and names the windows that have an earlier occurrence; their starts are
merged into maximal removal intervals for each document. A window in a third of all rows costs a bucket one entry for
each block, never one for each row. A very long text is hashed piece by piece and fills several blocks.

A window is known by 64 bits: n windows hold about n*n / 2**65 false pairs (none expected below 10**9 windows).

Cases: order is by doc_id (nulls last), then by a digest of doc_id and text, then by start; repeated rows are the same
document and get the same result; null and empty texts have no words; texts of fewer words than a window keep all; an
empty table gives an empty result; a doc_id of no integer type is refused; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, broadcast_if_small, bucket_of, buckets_for, keyed, materialize, mix, pack, release, text_bytes, unpack, whole_ids, word_runs

WINDOW = 20
#: Windows of a block.
BLOCK = 400_000
#: Bytes of text for each hash bucket; a bucket holds about a sixth as many windows.
BUCKET_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id


class Rolling:
    """Hashes of all windows of w values: differences of prefix sums of h[i] * base**i, scaled back by base**-i."""

    def __init__(self, w: int):
        self.w, self.n = w, 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            one = np.ones(self.n, np.uint64)
            self.up, self.down = one.copy(), one.copy()
            self.up[1:], self.down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up, self.down = np.multiply.accumulate(self.up), np.multiply.accumulate(self.down)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n, w = len(h), self.w
        if n < w:
            return np.zeros(0, np.uint64)
        self._grow(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)))
        return mix((sums[w:] - sums[:-w]) * self.down[: n - w + 1])


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """True where a run of equal values begins."""
    return np.concatenate((np.ones(min(1, len(sorted_values)), bool), sorted_values[1:] != sorted_values[:-1]))


def _pack_places(ids: np.ndarray, ks: np.ndarray, starts: np.ndarray) -> bytes:
    """Places in order of document: the documents once each, and their numbers of starts and gaps between starts."""
    run = np.flatnonzero(_runs(ks) | _runs(ids))
    counts = np.diff(np.append(run, len(ids))).astype(np.uint32)
    meta = [pack(np.diff(ids[run], prepend=0)), ks[run].tobytes(), pack(counts), pack(np.diff(starts, prepend=0).astype(np.int32))]
    return np.array([len(x) for x in meta], np.uint32).tobytes() + b"".join(meta)


def _unpack_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = 16 + np.cumsum(np.frombuffer(blob, np.uint32, 4)).astype(int)
    a, b, c, d = (blob[i:j] for i, j in zip([16, *ends], ends, strict=False))
    counts = unpack(c, np.uint32)
    return np.repeat(np.cumsum(unpack(a, np.int64)), counts), np.repeat(np.frombuffer(b, np.int64), counts), np.cumsum(unpack(d, np.int32), dtype=np.int64)


def _by_part(ids: np.ndarray, ks: np.ndarray, starts: np.ndarray, n_parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, places) of documents dealt over n_parts by their digest."""
    part = ks % n_parts
    order = np.lexsort((starts, ks, ids, part))
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(own):
            yield int(part[own[0]]), _pack_places(ids[own], ks[own], starts[own])


def _windows(batches: Iterator[pa.RecordBatch], w: int, n_buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: hashes and their places; rows of bucket -1 - part: places that a block itself finds repeated."""
    roll, hashes = Rolling(w), WordHashes()
    ids, ks, bases, found, total = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        doc_ids, keys, base = np.array(ids, np.int64), np.array(ks, np.int64), np.array(bases, np.int64)
        order = np.lexsort((base, keys, doc_ids))
        sizes = np.array([len(found[i]) for i in order], np.int64)
        h = np.concatenate([found[i] for i in order])
        for x in (ids, ks, bases, found):
            x.clear()
        which = np.repeat(order.astype(np.int32), sizes)
        start = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes - base[order], sizes)
        by_hash = np.argsort(h, kind="stable").astype(np.int32)
        first = np.zeros(len(h), bool)
        first[by_hash] = _runs(h[by_hash])
        # A repeated row finds each window at the same place of the same document: that is no earlier occurrence.
        lead = by_hash[np.maximum.accumulate(np.where(first[by_hash], np.arange(len(h), dtype=np.int32), 0))]
        later = np.zeros(len(h), bool)
        later[by_hash] = ~((doc_ids[which[by_hash]] == doc_ids[which[lead]]) & (keys[which[by_hash]] == keys[which[lead]]) & (start[by_hash] == start[lead]))
        del by_hash, lead
        out = [(-1 - part, None, at) for part, at in _by_part(doc_ids[which[later]], keys[which[later]], start[later], n_buckets)]
        keep = np.flatnonzero(first)
        bucket = bucket_of(h[keep], n_buckets)
        keep = keep[np.argsort(bucket, kind="stable")]
        upto = np.cumsum(np.bincount(bucket, minlength=n_buckets))
        for b in np.unique(bucket).tolist():
            part = keep[upto[b - 1] if b else 0 : upto[b]]
            out.append((b, h[part].tobytes(), _pack_places(doc_ids[which[part]], keys[which[part]], start[part])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "h", "at"])

    for batch in batches:
        for doc_id, k, text in zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), batch.column("text"), strict=True):
            data, rest, at = (text.as_py() or "").encode(), np.zeros(0, np.uint64), 0
            for words in word_runs(data):
                rest = np.concatenate((rest, hashes.of(words)))
                got = roll(rest)
                if len(got):
                    ids.append(_LAST if doc_id is None else doc_id)
                    ks.append(k)
                    bases.append(at)
                    found.append(got)
                    at += len(got)
                    total += len(got)
                    rest = rest[len(got) :]
                if total >= block:
                    yield flush()
                    total = 0
    if found:
        yield flush()
    del roll, hashes
    release()


def _count(t: pa.Table, n_parts: int) -> pa.Table:
    """The places of a bucket's windows that also occur earlier, by part; what a block has settled passes."""
    if t.num_rows and (bucket := t.column("bucket")[0].as_py()) < 0:
        return pa.table([pa.array([-1 - bucket] * t.num_rows, pa.int32()), t.column("at")], names=["part", "at"])
    ordered = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("h")])
    ordered.sort()
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    held = []
    if len(repeated):
        for x, at in zip(t.column("h"), t.column("at"), strict=True):
            h = np.frombuffer(x.as_buffer(), np.uint64)
            some = np.flatnonzero(repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h)
            if len(some):
                held.append((h[some], *(y[some] for y in _unpack_places(at.as_py()))))
    rows = []
    if held:
        h, ids, ks, starts = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((starts, ks, ids, h))
        h, ids, ks, starts = h[order], ids[order], ks[order], starts[order]
        lead = np.maximum.accumulate(np.where(_runs(h), np.arange(len(h)), 0))
        later = (ids != ids[lead]) | (ks != ks[lead]) | (starts != starts[lead])
        rows = list(_by_part(ids[later], ks[later], starts[later], n_parts))
        del h, ids, ks, starts, order, lead, held
    del repeated
    release()
    return pa.table([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "at"])


def _merge(t: pa.Table, window: int) -> pa.Table:
    """The maximal intervals of each document of a part."""
    ids, ks, starts = map(np.concatenate, zip(*(_unpack_places(x.as_py()) for x in t.column("at")), strict=True))
    order = np.lexsort((starts, ks, ids))
    ids, ks, starts = ids[order], ks[order], starts[order]
    new = _runs(ids) | _runs(ks)
    begin = np.flatnonzero(new | np.concatenate(([True], np.diff(starts) > window)))
    end = np.append(begin[1:], len(starts)) - 1
    spans = np.stack((starts[begin], starts[end] + window), 1).astype(np.int32)
    docs = np.flatnonzero(new[begin])
    cuts = [*docs.tolist(), len(begin)]
    del order, starts, new
    release()
    return pa.table([pa.array(ids[begin][docs]), pa.array(ks[begin][docs]), pa.array([spans[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["doc_id", "k", "spans"])


def removals(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id (its largest value for null), k and spans: the maximal removal intervals as packed (start, end) words."""
    n_buckets = buckets_for(text_bytes(docs), BUCKET_BYTES)
    rows = whole_ids(keyed(docs))
    rows = rows.mapInArrow(lambda it: _windows(it, window, n_buckets, block), "bucket int, h binary, at binary")
    places = rows.groupBy("bucket").applyInArrow(lambda t: _count(t, n_buckets), "part int, at binary")
    return materialize(places.groupBy("part").applyInArrow(lambda t: _merge(t, window), "doc_id long, k long, spans binary"), "removals")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by a space) and spans of removed words, of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    gone = removals(docs, window, block)
    gone = broadcast_if_small(gone.select(F.col("doc_id").alias("g_id"), F.col("k").alias("g_k"), "spans"), "spans")
    base = keyed(docs)
    met = base.join(gone, (F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))) == F.col("g_id")) & (F.col("k") == F.col("g_k")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept, spans = [], [], [], []
            for text, span in zip(batch.column("text"), batch.column("spans"), strict=True):
                words, at = (text.as_py() or "").encode().split(), np.frombuffer(span.as_py() or b"", np.int32).reshape(-1, 2).tolist()
                n.append(len(words))
                spans.append([{"start": i, "end": j} for i, j in at])
                for i, j in reversed(at):
                    del words[i:j]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])
        release()

    return met.mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS s FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS rn FROM w),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM r WHERE rn > 1),
k AS (SELECT d.doc_id, p.pos, g.pos IS NOT NULL AS gone, d.ws[p.pos + 1] AS word
      FROM (SELECT doc_id, unnest(range(0, len(ws))) AS pos FROM d) p JOIN d USING (doc_id) LEFT JOIN g ON g.doc_id = p.doc_id AND g.pos = p.pos)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(a.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id) a USING (doc_id)
"""
