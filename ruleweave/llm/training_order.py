"""Training-order materialisation: a keyed Feistel permutation gives every token sequence its slot in fixed-stride shards.

Tokens are the ids of a column (as bpe.encode makes them, of a stated width) or, without one, the bytes of the text. They
are cut into sequences of seq_len, numbered in order of document. A balanced Feistel network permutes [0, 4**h) and is
walked until it falls below the number of sequences, which makes it a permutation of just those. Slots are dealt to
tasks by range, some whole shards to each, and each shard is one file of records of equal stride, so record i of the
training order is found at shard i // per_shard, byte (i % per_shard) * stride: reads are sequential and resume at any
slot. A record is doc_id (8 bytes), number in the document (4), number of tokens (4), the tokens filled up with 0 (after
the shuffle), and the line feed with which Spark's text writer ends it; that writer commits whole files to any store.

Cases: null and empty texts have no sequences; very long texts have as many as they need; a null doc_id is written as the
largest number and read back as null; a doc_id of no integer type is refused; repeated rows are one document; an empty
table writes no shard and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, shared_dir, whole_ids

SEQ_LEN = 512
PER_SHARD = 16_384
#: Bytes of records that one task writes, in whole shards.
TASK_BYTES = 32 << 20
KEY = 20_240_601
ROUNDS = 4
_HEAD = "<qii"
_NONE = (1 << 63) - 1


def round_keys(key: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """An odd factor and a summand for each round, below 2**30."""
    out, x = [], key
    for _ in range(2 * rounds):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 34)
    return [(a | 1, b) for a, b in zip(out[::2], out[1::2], strict=True)]


def half_bits(n: int) -> int:
    """The least h with 4**h >= n."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The permutation of [0, n) at index."""
    h = half_bits(n)
    mask, v, todo = np.uint64((1 << h) - 1), index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = v[todo] >> np.uint64(h), v[todo] & mask
        for a, b in round_keys(key):
            left, right = right, left ^ (((right * np.uint64(a) + np.uint64(b)) >> np.uint64(7)) & mask)
        v[todo] = (left << np.uint64(h)) | right
        todo = todo[v[todo] >= n]
    return v.astype(np.int64)


def documents(docs: DataFrame, ids: str | None = None) -> DataFrame:
    """doc_id, data (the tokens' bytes) and k, a digest of both."""
    data = F.col(f"`{ids}`") if ids else F.encode("text", "utf-8")
    return whole_ids(docs.select("doc_id", data.alias("data"))).withColumn("k", F.xxhash64(F.lit(17), "doc_id", "data"))


def numbered(base: DataFrame, size: int) -> tuple[DataFrame, int]:
    """(doc_id, k, first: the number of a document's first sequence of size bytes) and the number of sequences in all."""
    sizes = base.select("doc_id", "k", F.ceil(F.octet_length("data") / size).cast("long").alias("n")).where("n > 0").distinct()
    ordered = sizes.repartitionByRange(F.coalesce("doc_id", F.lit(_NONE)), "k").sortWithinPartitions(F.coalesce("doc_id", F.lit(_NONE)), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column("n").to_numpy()
            upto = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array(upto - n), pa.array(upto), pa.array(np.full(len(n), part, np.int32))], names=["doc_id", "k", "local", "upto", "part"])
            total = int(upto[-1]) if len(n) else total

    local = materialize(ordered.mapInArrow(run, "doc_id long, k long, local long, upto long, part int"), "sequences")
    ends = sorted(tuple(r) for r in local.groupBy("part").agg(F.max("upto")).collect())  # a row for each partition
    base, rows = 0, []
    for part, n in ends:
        rows.append((part, base))
        base += n
    bases = local.sparkSession.createDataFrame(rows, "part int, base long")
    return local.join(F.broadcast(bases), "part").select("doc_id", "k", (F.col("base") + F.col("local")).alias("first")), base


def write_shards(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY, ids: str | None = None, width: int = 1) -> str:
    """Write the shards below path (by default a new one in the shared folder) and return it.

    ids names a binary column of token ids of width bytes each, little-endian.
    """
    path = path or f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    size = seq_len * width
    base = documents(docs, ids)
    first, n = numbered(base, size)
    first = broadcast_if_small(first.select(F.col("doc_id").alias("f_id"), F.col("k").alias("f_k"), "first", F.lit("").alias("none")), "none").drop("none")
    met = base.join(first, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("k") == F.col("f_k"))).select("doc_id", "data", "first")
    n_shards = -(-n // per_shard)
    each = max(1, TASK_BYTES // (per_shard * size))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=9, write_checksum=False, write_content_size=False).compress
        for batch in batches:
            at, records = [], []
            for doc_id, data, begin in zip(batch.column("doc_id").to_pylist(), batch.column("data"), batch.column("first").to_pylist(), strict=True):
                data = data.as_py()
                for i in range(0, len(data), size):
                    own = data[i : i + size]
                    at.append(begin + i // size)
                    records.append(squeeze(struct.pack(_HEAD, _NONE if doc_id is None else doc_id, i // size, len(own) // width) + own))
            yield pa.RecordBatch.from_arrays([pa.array(slots(np.array(at, np.int64), n, key)), pa.array(records, pa.binary())], names=["slot", "record"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, most, last = zstandard.ZstdDecompressor().decompress, struct.calcsize(_HEAD) + size, -1
        for batch in batches:
            at = batch.column("slot").to_numpy()
            new = np.flatnonzero(np.diff(at, prepend=last))  # a repeated row's records are the same, one stays
            last = int(at[-1]) if len(at) else last
            records = batch.column("record").take(pa.array(new))
            yield pa.RecordBatch.from_arrays([pa.array(at[new] // per_shard), pa.array([whole(x.as_py(), max_output_size=most).ljust(most, b"\0") for x in records], pa.binary())], names=["shard", "record"])

    records = met.mapInArrow(cut, "slot long, record binary")
    task = F.floor(F.col("slot") / (per_shard * each)).cast("int")
    dealt = records.repartitionById(max(1, -(-n_shards // each)), task).sortWithinPartitions("slot")
    plain = dealt.mapInArrow(spread, "shard long, record binary")
    plain.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").text(path)
    return path


def read_shards(spark: SparkSession, path: str, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, start: int = 0, width: int = 1) -> DataFrame:
    """slot, shard, offset, doc_id, seq_no, n_tokens and tokens of the records from slot start on; earlier shards aren't opened."""
    files = spark.read.format("binaryFile").load(path) if _exists(spark, path) else spark.createDataFrame([], "shard int, content binary")
    files = files.select(F.col("shard").cast("long").alias("shard"), "content").where(F.col("shard") >= start // per_shard)
    head = struct.calcsize(_HEAD)
    stride = head + seq_len * width + 1

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_py())
                for i in range(0, len(data), 2000 * stride):
                    rows = []
                    for j in range(i, min(len(data), i + 2000 * stride), stride):
                        doc_id, number, n = struct.unpack_from(_HEAD, data, j)
                        if (slot := shard * per_shard + j // stride) >= start:
                            rows.append((slot, shard, j, None if doc_id == _NONE else doc_id, number, n, bytes(data[j + head : j + head + n * width])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "tokens"])

    return files.mapInArrow(parse, "slot long, shard long, offset long, doc_id long, seq_no int, n_tokens int, tokens binary")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether any shard was written."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return any(s.isDirectory() for s in fs.listStatus(p)) if fs.exists(p) else False


def _oracle() -> str:
    step, v = "", "v"
    left, right = "(v >> h)", "(v & ((1::BIGINT << h) - 1))"
    lets = [f"SELECT i, n, h, {left} AS l0, {right} AS r0 FROM walk WHERE v >= n OR first"]
    for j, (a, b) in enumerate(round_keys(KEY)):
        lets.append(f"SELECT i, n, h, r{j} AS l{j + 1}, xor(l{j}, ((r{j} * {a} + {b}) >> 7) & ((1::BIGINT << h) - 1)) AS r{j + 1} FROM ({lets[-1]})")
    return f"""
WITH RECURSIVE s AS (SELECT doc_id, ((strlen(text) + {SEQ_LEN - 1}) // {SEQ_LEN})::BIGINT AS n, strlen(text) AS size FROM documents WHERE text <> ''),
f AS (SELECT doc_id, n, size, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS begin, sum(n) OVER () AS total FROM s),
q AS (SELECT doc_id, size, total::BIGINT AS total, (begin + i)::BIGINT AS i, i AS seq_no FROM (SELECT *, unnest(range(0, n)) AS i FROM f)),
walk AS (SELECT i, total AS n, greatest(1, ceil(log2(total) / 2))::BIGINT AS h, i AS v, true AS first FROM q
  UNION ALL SELECT i, n, h, (l{ROUNDS} << h) | r{ROUNDS}, false FROM ({lets[-1]}))
SELECT q.doc_id, q.seq_no::INTEGER AS seq_no, least({SEQ_LEN}, q.size - q.seq_no * {SEQ_LEN})::INTEGER AS n_tokens, w.v AS slot,
       w.v // {PER_SHARD} AS shard, (w.v % {PER_SHARD}) * {struct.calcsize(_HEAD) + SEQ_LEN + 1} AS "offset"
FROM q JOIN (SELECT i, v FROM walk WHERE NOT first AND v < n) w USING (i)
"""


ORACLE = _oracle()
