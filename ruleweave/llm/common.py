"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import discard, shared_dir, written  # noqa: F401  (operators take them from here)

#: Python's bytes.split() splits at exactly these characters: [\x20\x09-\x0D].
SPACE = r"[\x20\x09-\x0D]"
_space = re.compile(SPACE.encode()).search

#: Rows of small tables (a few numbers each) in a file.
ROWS_A_FILE = 500_000


def materialize(df: DataFrame, name: str, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and outlives lost executors.

    Where about as many narrow rows are expected, they go to files of ROWS_A_FILE, not to one for each shuffle partition.

    The shuffles and broadcasts behind df are of no more use then, but Spark keeps them until the driver collects its
    garbage; it is asked to, so that disk and executors hold those of one step and not of all. discard() deletes the table.
    """
    out = written(df if rows is None else df.coalesce(max(6, -(-rows // ROWS_A_FILE))), name, compression)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def salted_join(rows: DataFrame, found: DataFrame, key: str, by: Iterable[str], salts: int = 16) -> DataFrame:
    """rows with found's columns (one row a key), left; found is copied, so that no key's rows meet in one task."""
    own = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return own.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"], "left").drop("salt")


def fewer_tasks(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """Small input splits read together, about each documents in a task, and two tasks a core at least."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts, passed to Python in batches of few rows, since a text may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, so that no other column can clash with an operator's own names."""
    return docs.select(F.col("doc_id"), F.col("text"))


def whole_ids(docs: DataFrame) -> DataFrame:
    """docs with doc_id as long; a TypeError at once, before any work, where it is of no integer type."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"doc_id is {kind}; this operator orders documents by whole numbers: number them first")
    return docs.withColumn("doc_id", F.col("doc_id").cast("long"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and k, a 64-bit digest of both: repeated rows share it, other rows of one doc_id don't."""
    return texts(docs).withColumn("k", F.xxhash64(F.lit(17), "doc_id", "text"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that, and faster, where a text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the table; sizes the number of hash buckets, so that a bucket stays bounded."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def buckets_for(amount: float, each: float, least: int = 8) -> int:
    return max(least, int(np.ceil(amount / each)))


def broadcast_if_small(df: DataFrame, size_column: str, limit: int = 32 << 20) -> DataFrame:
    """Mark df (already written, so cheap to sum) for broadcast if its bytes are within limit; else leave it to a shuffle."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(size_column).cast("long"))).first()
    return F.broadcast(df) if rows * 48 + (size or 0) <= limit else df


def release() -> None:
    """Give memory that Python no longer needs back to the machine; workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_runs(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, of about size bytes at a time, so that a very long text is never split at once."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > size:
            space = _space(data, at + size)
            end = space.start() if space else end
        yield data[at:end].split()
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Even split of mixed 64-bit hashes over n buckets by their high half."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def pack(a: np.ndarray) -> bytes:
    """Integer array as compressed byte planes."""
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T if a.size else a.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if raw.size else np.zeros(0, kind)
