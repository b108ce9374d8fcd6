"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Documents are cut into pre-tokens with their positions; a block of documents ships each of its distinct pre-tokens
once, in hash buckets. A bucket meets every block's share of its words, encodes each distinct word once for the whole
table and sends the ids back to the blocks, which reassemble the documents by position. Decoding joins each id with
the token-byte table, whose size is the vocabulary's.

Cases: a null or empty text has no ids and decodes to nothing; very long texts and very long words are encoded whole; null and repeated doc_ids keep their rows; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import buckets_for, pack, release, text_bytes, texts, unpack

#: Pre-tokens of a block; a longer text forms a block alone.
BLOCK = 2_000_000
#: Bytes of text for each hash bucket of words.
BUCKET_BYTES = 12 << 20

_cached: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a word: of all neighbours the pair of least rank, the first of equal ones, becomes one, again and again.

    A heap holds the pairs, so a word of n bytes takes n * log(n) steps however long it is.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    gone = bytearray(n)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if gone[i] or j == n or end[j] != stop:
            continue  # one of the two has grown or gone meanwhile
        gone[j], end[i] = 1, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if not gone[i]]


def piece_finder(pattern: str):
    """findall of the pattern; texts of Latin characters only go through the faster standard module, same matches."""
    if ("find", pattern) in _cached:
        return _cached["find", pattern]
    import regex

    full = regex.compile(pattern).findall
    latin = [chr(c) for c in range(0x250)]
    group = lambda kind: "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == kind)
    space = "".join(re.escape(c) for c in latin if regex.match(r"\s", c))
    fast = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{group('L')}{group('N')}]").replace(r"\p{L}", f"[{group('L')}]").replace(r"\p{N}", f"[{group('N')}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")) if r"\p" in pattern else None
    only_latin = re.compile("[\0-ɏ]*").fullmatch

    def find(text: str) -> list[str]:
        return fast.findall(text) if fast and only_latin(text) else full(text)

    _cached["find", pattern] = find
    return find


def _squeeze(seq: np.ndarray, n_words: int) -> tuple[bytes, np.ndarray]:
    """Word numbers renamed by falling frequency, the first 255 in a byte each; and the new name of each word."""
    order = np.argsort(-np.bincount(seq, minlength=n_words), kind="stable")
    name = np.empty(n_words, np.uint32)
    name[order] = np.arange(n_words, dtype=np.uint32)
    seq = name[seq]
    short = zstandard.ZstdCompressor(level=3).compress(np.minimum(seq, 255).astype(np.uint8).tobytes())
    return len(short).to_bytes(8, "little") + short + pack(seq[seq >= 255]), order


def _spread(blob: bytes) -> np.ndarray:
    n = 8 + int.from_bytes(blob[:8], "little")
    seq = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:n]), np.uint8).astype(np.uint32)
    seq[seq == 255] = unpack(blob[n:], np.uint32)
    return seq


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0: a block's documents as numbers of local words; of kind 1: its distinct words in one bucket."""
    find, made = piece_finder(pattern), 0
    local: dict[str, int] = defaultdict()
    local.default_factory = local.__len__
    ids, seqs, total = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal made, total
        block = (TaskContext.get().partitionId() << 24) + made
        made += 1
        names = list(local)
        numbers, order = _squeeze(np.concatenate(seqs), len(names))
        words = [names[i].encode() for i in order.tolist()]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % n_buckets for w in words), np.uint32, len(words))
        squeeze = zstandard.ZstdCompressor(level=3).compress
        rows = [(block, 0, -block - 1, numbers, pack(bucket), pack(np.fromiter(map(len, seqs), np.uint32, len(seqs))), list(ids))]
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(part):
                own = [words[i] for i in part]
                rows.append((block, 1, int(bucket[part[0]]), squeeze(b"".join(own)), pack(np.fromiter(map(len, own), np.uint32, len(own))), None, None))
        local.clear()
        ids.clear()
        seqs.clear()
        total = 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(id_type)), strict=True)], names=["block", "kind", "bucket", "a", "b", "c", "doc_ids"])

    id_type = pa.int64()
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            pieces = find(text) if text else []
            ids.append(doc_id)
            seqs.append(np.fromiter(map(local.__getitem__, pieces), np.uint32, len(pieces)))
            total += len(pieces)
            if total >= BLOCK or len(ids) >= 100_000:
                yield flush()
    if ids:
        yield flush()
    del local, seqs
    release()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every whole text."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(ranks)
    doc_id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    n_buckets = buckets_for(text_bytes(docs), BUCKET_BYTES)
    cut = texts(docs).mapInArrow(lambda batches: _blocks(batches, pattern, n_buckets), (row := f"block long, kind int, bucket long, a binary, b binary, c binary, doc_ids array<{id_type}>"))

    def encode_bucket(t: pa.Table) -> pa.Table:
        """Each distinct word of the bucket is encoded once; every block gets the ids of its own words, in its order.

        A block's documents pass on as they are: one shuffle carries both, so both come from the same run of the mapper.
        """
        if t.num_rows and t.column("kind")[0].as_py() == 0:
            return t
        known_ranks = shared.value
        known: dict[bytes, bytes] = {}
        blocks, counts, tokens = [], [], []
        for block, a, b in zip(*(t.column(c) for c in ("block", "a", "b")), strict=True):
            raw, ends = zstandard.ZstdDecompressor().decompress(a.as_py()), np.cumsum(unpack(b.as_py(), np.uint32), dtype=np.int64).tolist()
            out, start = [], 0
            for end in ends:
                word = raw[start:end]
                start = end
                if (got := known.get(word)) is None:
                    got = known[word] = np.array(merge(word, known_ranks), np.uint32).tobytes()
                out.append(got)
            blocks.append(block.as_py())
            counts.append(pack(np.fromiter(map(len, out), np.uint32, len(out)) // np.uint32(4)))
            tokens.append(pack(np.frombuffer(b"".join(out), np.uint32)))
        del known
        release()
        done = {"block": blocks, "kind": [1] * len(blocks), "bucket": t.column("bucket"), "a": tokens, "b": counts, "c": [None] * len(blocks), "doc_ids": [None] * len(blocks)}
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x, t.schema.field(c).type) for c, x in done.items()], names=list(done))

    rows = cut.groupBy("bucket").applyInArrow(encode_bucket, row)

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for batch in batches for row in batch.to_pylist()]
        heads = [row for row in got if row["kind"] == 0]
        if len(heads) != 1:
            raise RuntimeError("a block came twice or not at all; the input must be a table that reads alike each time")
        seq, (bucket, lengths) = _spread(heads[0]["a"]), (unpack(heads[0][c], np.uint32) for c in "bc")
        count, start, parts, base = np.full(len(bucket), -1, np.int64), np.zeros(len(bucket), np.int64), [], 0
        for row in got:
            if row["kind"]:
                own, n = np.flatnonzero(bucket == row["bucket"]), unpack(row["b"], np.uint32).astype(np.int64)
                count[own], start[own] = n, base + np.cumsum(n) - n
                parts.append(unpack(row["a"], np.uint32))
                base += len(parts[-1])
        if (count < 0).any():
            raise RuntimeError("a block has lost words; the input must be a table that reads alike each time")
        tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends, first = np.cumsum(lengths, dtype=np.int64), 0
        while first < len(lengths):  # whole documents, some at a time
            lo = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, lo + (1 << 18))))
            n = count[own := seq[lo : ends[last - 1]]]
            upto = np.concatenate(([0], np.cumsum(n)))
            flat = tokens[np.repeat(start[own] - upto[:-1], n) + np.arange(upto[-1])].astype("<u4")
            cuts = [0, *upto[ends[first:last] - lo].tolist()]
            done = [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(heads[0]["doc_ids"][first:last], doc_id_type), pa.array([len(x) // 4 for x in done], pa.int64()), pa.array(done, pa.binary())], names=["doc_id", "n_tokens", "ids"])
            first = last
        del tokens, count, start, seq, bucket
        release()

    return rows.groupBy("block").applyInArrow(reassemble, f"doc_id {id_type}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded with the column decoded: the bytes of ids. A null list of ids decodes to null."""
    table = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {i: b for b, i in table.value.items()}.__getitem__
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                done = [None if x is None else b"".join(map(by_id, np.frombuffer(x, "<u4").tolist())) for x in (y.as_py() for y in part.column(at))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, pa.binary())], names=[*part.schema.names, "decoded"])
        release()

    return encoded.mapInArrow(run, schema)
