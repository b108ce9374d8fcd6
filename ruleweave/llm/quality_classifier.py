"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

The models are generative: a text is drawn n-gram by n-gram (hashed words and pairs of neighbours), each with its share
of the model. A share is estimated from the documents that hold the n-gram, so that one document's repetitions don't make
it common: for the target among a bounded sample of those labelled good (quality 1, not toxic), for the raw model among
all documents. A document's log weight is the sum of the log ratios of all its n-grams, each as often as it occurs, plus
the normalisers of the two models (once and for each n-gram), which are fitted so that the sample's good documents weigh
more than 0 and its bad ones less. Of log weight over temperature plus standard Gumbel noise the k largest are kept: a
sample without replacement by weight at temperature 1, a sharper one below, where documents that the models tell apart
well are hardly left to chance. k is a parameter; by default it is the number of documents likelier as target than as raw
text (log weight over 0).

Cases: a null text and one without words hold no n-gram; very long texts count whole; null and repeated doc_ids are rows
like any other (equal rows get equal noise and stay or go together, and so do ties of the k-th key); labels without a
document, null labels and repeated labels (the worst counts) are allowed; without any labelled good document all weigh 0
and by default all are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, fewer_tasks, materialize, release

#: Buckets of words and of word pairs; the model's size.
WORDS, PAIRS = 1 << 17, 1 << 16
#: Labelled documents in the sample, of each kind at most.
SAMPLE, SLOTS = 20_000, 32
#: Occurrences added to both of a bucket's counts, and at how many standard deviations of chance a log ratio counts half.
PRIOR, SIGMAS = 0.5, 3.5
#: A good document lost counts as so many bad ones kept, where the offset is fitted.
GOOD_WEIGHT = 3.0
#: Log weights are divided by it before noise is added.
TEMPERATURE = 0.1
SEED = 5
_token = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+").findall


def ngrams(text: str | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's tokens and of its pairs of neighbours, and how often each occurs."""
    h = hashes.of(_token(text.encode().lower())) if text else np.zeros(0, np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    buckets, n = np.unique(np.concatenate(((h >> np.uint64(20)) % np.uint64(WORDS), (pairs >> np.uint64(40)) % np.uint64(PAIRS) + np.uint64(WORDS))), return_counts=True)
    return buckets.astype(np.int64), n


def labelled_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(l_id, good) of at most 2 * size documents, the first of each kind by a digest of doc_id.

    One of each of SLOTS * size slots of digests is looked at, so that no task gathers all labels.
    """
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg((F.min("quality").eqNullSafe(1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"))
    slot = F.pmod(F.xxhash64(F.lit(SEED), "l_id"), F.lit(size * SLOTS).cast("long"))
    one = judged.groupBy("good", slot.alias("slot")).agg(F.min("l_id").alias("l_id"))
    for r in one.groupBy("good").count().collect():
        if r["count"] > size:  # the size-th slot of the kind parts its first labels from the others
            last = kth_largest(one.where(F.col("good") == r.good).select((-F.col("slot")).cast("double").alias("key")), size)
            one = one.where((F.col("good") != r.good) | (-F.col("slot") >= F.lit(int(last))))
    return one.select("l_id", "good")


def shrinkage(count: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """How much of a log ratio is believed: from 0 to 1, without a cut, by the standard deviations between the counts."""
    far = (np.abs(count - expected) / np.sqrt(expected + 1) / SIGMAS) ** 8
    return far / (1 + far)


def log_ratios(marked: DataFrame) -> np.ndarray | None:
    """log(target share / raw share) of every bucket; None without target text. marked: text, good."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, raw, target = WordHashes(), np.zeros(WORDS + PAIRS, np.int64), np.zeros(WORDS + PAIRS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
                own, _ = ngrams(text.as_py(), hashes)
                raw[own] += 1
                if good:
                    target[own] += 1
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])
        release()

    # The sums have a row for each bucket, however large the table.
    got = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(WORDS + PAIRS), np.zeros(WORDS + PAIRS)
    at = got.column("bucket").to_numpy()
    raw[at], target[at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    if not target.sum():
        return None
    out = np.zeros(WORDS + PAIRS, np.float32)
    for part in (slice(0, WORDS), slice(WORDS, None)):
        r, t = raw[part], target[part]
        # The usual n-gram weighs nothing: raw counts are scaled by the median ratio over raw occurrences.
        rate = t / np.maximum(r, 1)
        order = np.argsort(rate)
        usual = rate[order][np.searchsorted(np.cumsum(r[order]), r.sum() / 2)]
        expected = r * (usual or t.sum() / r.sum())
        # Counts that differ by little more than chance would add noise to each document's sum: their ratios shrink.
        out[part] = np.log((t + PRIOR) / (expected + PRIOR)) * shrinkage(t, expected)
    return out


def kth_largest(keys: DataFrame, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest of column key, by histograms of ever narrower ranges; no sort, no gathering of all rows."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        n = inside.count() if width > 0 else 0
        if n <= few or low + width <= low:
            if width <= 0 or low + width <= low:
                return low
            return sorted((r.key for r in inside.collect()), reverse=True)[k - above - 1]
        place = F.least(F.floor((F.col("key") - F.lit(low)) / width), F.lit(bins - 1)).cast("int")
        counts = dict(inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).select("bin", F.struct("n", "lo", "hi")).collect())
        for b in sorted(counts, reverse=True):
            if above + counts[b][0] >= k:
                low, high = counts[b][1], counts[b][2]
                break
            above += counts[b][0]


def best_offset(rows: list[tuple[float, int, bool]], weight_good: float = GOOD_WEIGHT) -> tuple[float, float]:
    """What to add to totals, once and for each n-gram, so that positive ones tell good documents from bad ones best."""
    usual = np.median([a / n for a, n, good in rows if good and n] or [0.0])
    tried = [(*_cut([(a + each * n, good) for a, n, good in rows], weight_good), each) for each in abs(float(usual)) * np.array([0, 0.5, 1, 2, 3, 4, 6, 8])]
    _, offset, each = min(tried)
    return offset, float(each)


def _cut(rows: list[tuple[float, bool]], weight_good: float) -> tuple[float, float]:
    """(cost of errors, offset) of the best cut between bad and good totals."""
    if not rows or all(g for _, g in rows) or not any(g for _, g in rows):
        return 0.0, 0.0
    rows = sorted(rows)
    x, good = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    ends = np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1  # a cut never parts equal totals
    cuts = np.concatenate(([0], ends))
    wrong = weight_good * np.concatenate(([0], np.cumsum(good)))[cuts] + np.concatenate((np.cumsum(~good[::-1])[::-1], [0]))[cuts]
    cut, cost = int(cuts[wrong.argmin()]), float(wrong.min())
    if cut in (0, len(x)):
        return cost, float(1 - x[0]) if cut == 0 else float(-1 - x[-1])
    return cost, float(-(x[cut - 1] + x[cut]) / 2)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, sample: int = SAMPLE) -> DataFrame:
    """doc_id, k (a digest of the row), n_grams, log_weight, key (with its noise) and kept (the k largest keys), for every row."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(labelled_sample(labels, sample))  # at most 2 * sample rows
    marked = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("l_id"), "left").select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("k"), "text", "good")
    marked = fewer_tasks(marked, docs.count())
    ratios = log_ratios(marked.select("text", "good"))
    shared = spark.sparkContext.broadcast(ratios)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratios = WordHashes(), shared.value
        for batch in batches:
            sums, sizes = [], []
            for text in batch.column("text"):
                own, n = ngrams(text.as_py(), hashes)
                sizes.append(int(n.sum()))
                sums.append(float(ratios[own] @ n) if ratios is not None else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), batch.column("good"), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["doc_id", "k", "good", "n_grams", "total"])
        release()

    scored = materialize(marked.mapInArrow(weigh, f"doc_id {id_type}, k long, good boolean, n_grams long, total double"), "weights")
    judged = scored.where("good IS NOT NULL AND n_grams > 0").select("total", "n_grams", "good").collect()  # bounded by the sample
    offset, each = best_offset([tuple(r) for r in judged]) if ratios is not None else (0.0, 0.0)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "k"), 11).cast("double") + 0.5) / float(1 << 53)
    weight = F.col("total") + F.lit(offset) + F.lit(each) * F.col("n_grams")
    keyed = scored.select("doc_id", "k", "n_grams", weight.alias("log_weight"), (weight / temperature - F.log(-F.log(uniform))).alias("key"))
    if k is None:
        k = keyed.where("log_weight > 0").count() if ratios is not None else keyed.count()
    k = min(k, keyed.count())
    least = kth_largest(keyed.select("key"), k) if k else float("inf")
    return keyed.withColumn("kept", F.col("key") >= F.lit(least))
