"""Exact n-gram Jaccard join in the Jaccard metric.

Documents become sets of word shingles; equal sets are one node. A first, exact split cuts the table into regions:
two sets within the distance differ in at most H shingles, so of H + 1 + e hash classes of the shingles at least
e + 1 hold the same shingles in both. Nodes that agree on a class fall into one region (of the components of that
agreement), and each leaves out its e weakest classes, which hold few shingles or those of passages that many documents
share; the strongest class of an agreement is left out by neither, so no linked pair is ever apart. Document pivots cannot do this first cut: sets that share
next to nothing lie at distance 1 from every pivot, and windows of twice the radius then copy all rows everywhere.
Inside a region the join is the metric one: pivots make Voronoi cells, a set joins every cell whose pivot is within
its nearest pivot's distance plus twice the radius, cells are joined recursively, and every link is checked exactly.
Regions are cut anew by classes of their own. One that stays large is cut by its rarest shingles: those that no other set
of the region has link nothing, and two linked sets share one of the rarest others, of which each takes as many as the
percentage leaves it to miss, and one; long sets that meet by chance drop out here, as they have few shared shingles. What
then is large is cut into Voronoi cells by all its tasks: pivots link what lies within the radius, cells whose sets are all in one component are done, small ones are joined in memory and
large ones cut again, by pivots that no component has taken in. Where cells do not part a region (its sets are as far
from all pivots), sets outside its main component are joined with all, block by block. Links inside a found component add
nothing and are skipped.

Nodes are known by 64-bit digests of their sets.

Cases: null, empty and wordless texts have the empty set and link with nothing; a text of fewer words than a shingle
is one shingle; null doc_ids are documents whose component_id is null when no other document is in it; repeated rows
share a component; very long texts are read whole; an empty table gives an empty result; a doc_id of no integer type is
refused; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, broadcast_if_small, bucket_of, buckets_for, discard, keyed, materialize, mix, pack, release, salted_join, text_bytes, unpack, whole_ids
from .components import connected_components
from .substring_dedup import Rolling

SHINGLE = 3
PERCENT = 90
#: Shingles of a block of documents.
BLOCK = 1_000_000
BUCKET_BYTES = 16 << 20
#: Nodes, and shingles of nodes, of a block: regions of more are joined block against block.
REGION, REGION_SHINGLES = 4096, 1_000_000
#: A shingle in this share of documents is frequent; so many of them are known at most; classes added for frequent ones.
SHARE, MAX_FREQUENT, SLACK = 0.002, 500_000, 0.15
#: Times that regions are cut anew, from the second time on only those of more than REGION nodes; then, by rarest shingles,
#: those of more than REGION nodes or REGION_SHINGLES.
LEVELS, RAREST = 3, 2
_CELL, _PIVOTS = 48, 6
#: Pivots of a region that is cut by many tasks, how often its cells are cut again, and to how many copies of its sets at most.
PIVOTS, ROUNDS, COPIES = 32, 4, 3


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, w: int):
        self.w, self.words, self.roll = w, WordHashes(), Rolling(w)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of_bytes(text.encode().lower() if text else b"")

    def of_bytes(self, lowered: bytes) -> np.ndarray:
        words = lowered.split()
        if not words:
            return np.zeros(0, np.uint64)
        h = self.words.of(words)
        if len(h) < self.w:
            return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64))
        return np.unique(self.roll(h))


class Classes:
    """The exact split: for each range of sizes, how many hash classes, and how many of them give no signature."""

    def __init__(self, percent: int, frequent: np.ndarray):
        self.percent, self.edges, self.frequent = percent, [1], frequent
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * 1.25), self._partner(self.edges[-1]) + 1))
        self.known: dict[int, tuple[int, int]] = {}

    def _partner(self, n: int) -> int:
        """The largest set that can link with one of n shingles."""
        return n * 100 // self.percent

    def plan(self, tag: int) -> tuple[int, int]:
        """(classes, weakest of them that give no signature) of sets that meet under a tag."""
        if tag not in self.known:
            union = self._partner(self.edges[tag + 1] - 1)
            differ = union - -(-union * self.percent // 100)
            least = max(1, self.edges[tag] * self.percent // 100)
            for strong in (3, 2, 1):
                k = e = 0
                for _ in range(20):
                    k, mean = differ + 1 + e, least / (differ + 1 + e)
                    weak = k * math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(strong))
                    e = math.ceil(weak + 3 * math.sqrt(weak) + 1 + SLACK * (differ + 1))
                if strong == 1 or k <= 1.5 * (differ + 1) + 2:
                    break
            self.known[tag] = (differ + 1 + e if differ else 0, e)
        return self.known[tag]

    def tags(self, n: int) -> list[int]:
        own = int(np.searchsorted(self.edges, n, side="right")) - 1
        return [own, own + 1] if self._partner(n) >= self.edges[own + 1] else [own]

    def signatures(self, s: np.ndarray, region: int = 0) -> np.ndarray:
        """A set's signatures in a region: of each tag's classes all but the weakest that the plan allows.

        Two sets within the distance agree on one class more than each leaves out. Strength hangs on a class's content and number
        alone, so the strongest class they agree on is among the signatures of both. Classes rank by their rare shingles
        first: a passage that many documents share links none of them that has enough text of its own.
        """
        rare = np.ones(len(s), bool)
        if len(self.frequent) and len(s):
            rare = self.frequent[np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)] != s
        out, salt = [], mix(np.array([region], np.int64).view(np.uint64)) if region else np.zeros(1, np.uint64)
        for tag in self.tags(len(s)) if len(s) else ():
            k, weakest = self.plan(tag)
            if k:
                spread = mix((s ^ salt) + np.uint64(0x9E3779B97F4A7C15 * (tag + 1) % (1 << 64)))
                own = bucket_of(spread, k)
                total = np.zeros(k, np.uint64)
                np.add.at(total, own, mix(spread))
                sizes = np.bincount(own, minlength=k)
                here = np.lexsort((np.arange(k), sizes, np.bincount(own[rare], minlength=k)))[weakest:]
                out.append(mix(total[here] + here.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(tag << 32) + sizes[here].astype(np.uint64) + salt))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) - (1 << 63)


def _dealt(sig: np.ndarray, of: np.ndarray, n_buckets: int) -> list[tuple[int, bytes, bytes]]:
    """For each bucket its signatures and, in runs, the nodes that have them."""
    bucket, rows = bucket_of(sig, n_buckets), []
    order = np.lexsort((of, bucket))
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(part):
            run = np.flatnonzero(np.concatenate(([True], of[part][1:] != of[part][:-1])))
            counts = pack(np.diff(np.append(run, len(part))).astype(np.uint32))
            rows.append((int(bucket[part[0]]), sig[part].tobytes(), len(counts).to_bytes(4, "little") + counts + of[part][run].tobytes()))
    return rows


def _undealt(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a bucket in order, and their nodes."""
    sig = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t.column("sig")])
    of = []
    for x in t.column("nodes"):
        x = x.as_py()
        at = 4 + int.from_bytes(x[:4], "little")
        of.append(np.repeat(np.frombuffer(x, np.int64, offset=at), unpack(x[4:at], np.uint32)))
    of = np.concatenate(of)
    order = np.lexsort((of, sig))
    return sig[order], of[order]


def _signed(batches: Iterator[pa.RecordBatch], w: int, percent: int, n_buckets: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: signatures and their nodes; rows of a negative bucket: documents with node and set size."""
    sets, classes, made = Shingles(w), Classes(percent, frequent), 0
    names = ["bucket", "sig", "nodes", "doc_id", "k", "node", "n"]
    types = [pa.int32(), pa.binary(), pa.binary(), *map(pa.list_, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
    ids, ks, nodes, sizes, sigs, seen, total = [], [], [], [], [], set(), 0

    def flush() -> pa.RecordBatch:
        nonlocal made, total
        made += 1
        rows = [(-1 - made % n_buckets, None, None, list(ids), list(ks), list(nodes), list(sizes))]
        if sigs:
            of = np.repeat(np.array([x for x, _ in sigs], np.int64), [len(x) for _, x in sigs])
            rows += [(*x, *[None] * 4) for x in _dealt(np.concatenate([x for _, x in sigs]), of, n_buckets)]
        for x in (ids, ks, nodes, sizes, sigs, seen):
            x.clear()
        total = 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for doc_id, k, region, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "region")), batch.column("text"), strict=True):
            s = sets(text.as_py())
            node = node_of(s)
            ids.append(doc_id)
            ks.append(k)
            nodes.append(node)
            sizes.append(len(s))
            if node not in seen:
                seen.add(node)
                if len(got := classes.signatures(s, region)):
                    sigs.append((node, got))
            total += len(s)
            if total >= BLOCK or len(ids) >= 50_000:
                yield flush()
    if ids:
        yield flush()
    del sets
    release()


def _pairs_by_part(a: np.ndarray, b: np.ndarray, n_parts: int) -> list[tuple[int, bytes]]:
    both = np.unique(np.stack((a, b), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    part = both[:, 0] % n_parts
    order = np.argsort(part, kind="stable")
    return [(int(part[own[0]]), both[own].tobytes()) for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(own)]


def _agree(t: pa.Table, n_parts: int) -> pa.Table:
    """Links from each node of a signature to the signature's least node, by part; documents pass."""
    names, types = ["part", "pairs", "doc_id", "k", "node", "n"], [pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 4]
    if t.num_rows and t.column("bucket")[0].as_py() < 0:
        return pa.table([pa.nulls(t.num_rows, pa.int32()), pa.nulls(t.num_rows, pa.binary()), *(t.column(c).cast(pa.list_(pa.int64())) for c in names[2:])], names=names)
    sig, of = _undealt(t)
    first = np.concatenate((np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]))
    lead = of[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
    link = of != lead
    del sig
    release()
    rows = _pairs_by_part(of[link], lead[link], n_parts)
    return pa.table([pa.array(c, k) for c, k in zip(zip(*((p, x, None, None, None, None) for p, x in rows), strict=True) if rows else [()] * 6, types, strict=True)], names=names)


def _spread(batches: Iterator[pa.RecordBatch], w: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """All shingles of sets, told apart by region, in buckets."""
    make, nodes, sets, total = Shingles(w), [], [], 0

    def flush() -> pa.RecordBatch:
        rows = _dealt(np.concatenate(sets), np.repeat(np.array(nodes, np.int64), [len(x) for x in sets]), n_buckets)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "sig", "nodes"])

    for batch in batches:
        for node, region, text in zip(batch.column("node").to_pylist(), batch.column("region").to_pylist(), batch.column("text"), strict=True):
            nodes.append(node)
            sets.append(mix(make(text.as_py()) ^ mix(np.array([region], np.int64).view(np.uint64))))
            total += len(sets[-1])
            if total >= BLOCK:
                yield flush()
                nodes, sets, total = [], [], 0
    if sets:
        yield flush()
    del make
    release()


def _shared(t: pa.Table, n_parts: int) -> pa.Table:
    """Shingles that several sets of a region have and in how many, by parts of the sets."""
    sig, of = _undealt(t)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1])))
    times = np.diff(np.append(first, len(sig)))
    times = np.repeat(times, times)
    several = times > 1
    sig, of, times = sig[several], of[several], times[several].astype(np.uint32)
    part = of % n_parts
    order = np.argsort(part, kind="stable")
    rows = [(int(part[own[0]]), sig[own].tobytes(), of[own].tobytes(), times[own].tobytes()) for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(own)]
    release()
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "sig", "of", "times"])


def _rarest(shared: pa.Table, sizes: pa.Table, percent: int, n_buckets: int) -> pa.Table:
    """The rarest shared shingles of a part's sets, dealt: of those that a set shares, all but what a linked set must have, and one.

    A linked set has percent of a set's shingles at least, and both order them alike, so the rarest that they share is among
    these in both.
    """
    types = [pa.int32(), pa.binary(), pa.binary()]
    sig, of, times = (np.concatenate([np.frombuffer(x.as_py(), k) for x in shared.column(c)] or [np.zeros(0, k)]) for c, k in (("sig", np.uint64), ("of", np.int64), ("times", np.uint32)))
    node, n = np.array(sizes.column("node").to_pylist(), np.int64), np.array(sizes.column("set_size").to_pylist(), np.int64)
    order = np.lexsort((sig, times, of))
    sig, of = sig[order], of[order]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
    own = np.diff(np.append(begin, len(of)))
    by = np.argsort(node)
    must = -(-n[by] * percent // 100)[np.searchsorted(node[by], of[begin])] if len(begin) else own
    few = np.arange(len(of)) - np.repeat(begin, own) <= np.repeat(own - must, own)
    rows = _dealt(sig[few], of[few], n_buckets)
    release()
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 3, types, strict=True)], names=["bucket", "sig", "nodes"])


def _distinct_pairs(t: pa.Table) -> pa.Table:
    both = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("pairs")]).reshape(-1, 2), axis=0)
    return pa.table([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def frequent_shingles(docs: DataFrame, w: int) -> np.ndarray:
    """Sorted hashes of shingles found in at least SHARE of the documents, or nearly, counted over all documents.

    A block passes on those in SHARE of its own documents, so every frequent one comes from some block, and their number
    is bounded by the mean size of a set over SHARE, however many documents there are. Any table gives the same links:
    it only spares work.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held, n = Shingles(w), [], 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            some = times >= max(3, SHARE * len(held))
            return pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(times[some].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.append(make(text.as_py()))
                n += len(held[-1])
                if n >= 2 * BLOCK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        release()

    least = SHARE * docs.count() / 2
    got = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3.0, least))
    return np.sort(got.orderBy(F.desc("n"), "h").limit(MAX_FREQUENT).select("h").toArrow().column("h").to_numpy().view(np.uint64))


class Region:
    """The metric join of sets held in memory; links are gathered in a forest."""

    def __init__(self, sets: list[np.ndarray], percent: int, root: np.ndarray | None = None):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        names, self.codes = np.unique(flat, return_inverse=True)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(names), bool)
        self.percent, self.radius = percent, 1 - percent / 100 + 1e-9
        #: Sets of one root are known to be in one component.
        self.root, self.links = np.arange(len(sets)) if root is None else np.unique(root, return_inverse=True)[1], []

    def _codes(self, members: np.ndarray) -> np.ndarray:
        n = self.sizes[members]
        return self.codes[np.repeat(self.begin[members] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _from(self, pivot: int, members: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances from pivot to members; links those within the radius."""
        own = self.codes[self.begin[pivot] : self.begin[pivot] + self.sizes[pivot]]
        self.mark[own] = True
        n = self.sizes[members]
        inter = np.add.reduceat(self.mark[codes], np.cumsum(n) - n, dtype=np.int64)
        self.mark[own] = False
        union = n + self.sizes[pivot] - inter
        for j in members[(100 * inter >= self.percent * union) & (self.root[members] != self.root[pivot])].tolist():
            if self.root[j] != self.root[pivot]:
                self.links.append((pivot, j))
                self.root[self.root == self.root[j]] = self.root[pivot]
        return 1 - inter / union

    def join(self, members: np.ndarray) -> None:
        if len(members) < 2 or (self.root[members] == self.root[members[0]]).all():
            return
        codes = self._codes(members)
        if len(members) > _CELL:
            pivots, dist = [0], [self._from(int(members[0]), members, codes)]
            while len(pivots) < _PIVOTS and (far := np.min(dist, axis=0)).max() > self.radius:
                pivots.append(int(far.argmax()))
                dist.append(self._from(int(members[pivots[-1]]), members, codes))
            cells = [members[d <= np.min(dist, axis=0) + 2 * self.radius] for d in dist]
            if max(map(len, cells)) <= 0.8 * len(members):
                for cell in cells:
                    self.join(cell)
                return
            near = dist[0]
        else:
            near = self._from(int(members[0]), members, codes)
        # Cells that do not shrink: each set meets those of other components that the first pivot's window leaves.
        for at, i in enumerate(members.tolist()):
            rest = np.flatnonzero((np.abs(near - near[at]) <= self.radius) & (self.root[members] != self.root[i]))
            rest = rest[(rest > at) & (100 * np.minimum(self.sizes[members[rest]], self.sizes[i]) >= self.percent * np.maximum(self.sizes[members[rest]], self.sizes[i]))]
            if len(rest):
                self._from(i, members[rest], self._codes(members[rest]))


def _join_regions(t: pa.Table, w: int, percent: int) -> pa.Table:
    """Links of the regions of a table, as a forest."""
    region, node, root = (np.array(t.column(c).to_pylist(), np.int64) for c in ("region", "node", "root"))
    make, plain, out = Shingles(w), zstandard.ZstdDecompressor(), []
    packed = t.column("packed")
    order = np.argsort(region, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
        own = own[np.unique(node[own], return_index=True)[1]]
        found = Region([make.of_bytes(plain.decompress(packed[int(i)].as_py())) for i in own], percent, root[own])
        found.join(np.arange(len(own)))
        out += [(int(node[own[i]]), int(node[own[j]])) for i, j in found.links]
    del make
    release()
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _to_pivots(sets: list[np.ndarray], pivots: list[np.ndarray], step: int = 100_000) -> np.ndarray:
    """Sizes of the intersections of sets with up to 64 pivots."""
    table, at = np.unique(np.concatenate(pivots), return_inverse=True)
    bits = np.zeros(len(table), np.uint64)
    np.bitwise_or.at(bits, at, np.repeat(np.uint64(1) << np.arange(len(pivots), dtype=np.uint64), [len(x) for x in pivots]))
    out, first = np.zeros((len(sets), len(pivots)), np.int64), 0
    while first < len(sets):
        last, total = first + 1, len(sets[first])
        while last < len(sets) and total + len(sets[last]) <= step:
            total += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        place = np.minimum(np.searchsorted(table, flat), len(table) - 1)
        hit = np.where(table[place] == flat, bits[place], np.uint64(0))
        of = np.repeat(np.arange(first, last), [len(x) for x in sets[first:last]])
        for j in range(len(pivots)):
            out[:, j] += np.bincount(of[(hit >> np.uint64(j)) & np.uint64(1) == 1], minlength=len(sets))[: len(sets)]
        first = last
    return out


def _assign(members: pa.Table, pivots: pa.Table, w: int, percent: int) -> pa.Table:
    """For each set of a region the cells it joins, its own first, and the pivots within the radius."""
    make, plain = Shingles(w), zstandard.ZstdDecompressor()
    of = lambda c: [make.of_bytes(plain.decompress(x.as_py())) for x in c]
    sets, centres = of(members.column("packed")), of(pivots.column("text"))
    named = np.array(pivots.column("pivot").to_pylist(), np.int64)
    inter = _to_pivots(sets, centres)
    sizes = np.array([len(x) for x in sets], np.int64)
    union = sizes[:, None] + np.array([len(x) for x in centres], np.int64)[None, :] - inter
    near, far = 100 * inter >= percent * union, 1 - inter / union
    least = far.min(1, keepdims=True)
    joins = far <= least + 2 * (1 - percent / 100) + 1e-9
    region = np.array(members.column("region").to_pylist(), np.int64)
    cell = mix((mix(named.view(np.uint64)) + np.uint64(1))[None, :] ^ region.view(np.uint64)[:, None]).view(np.int64)
    del make, sets, centres
    release()
    return pa.table([members.column("node"), members.column("packed"), members.column("set_size"), members.column("region"), pa.array([c[j].tolist() for c, j in zip(cell, joins, strict=True)], pa.list_(pa.int64())), pa.array([named[j].tolist() for j in near], pa.list_(pa.int64()))], names=["node", "packed", "set_size", "region", "cells", "near"])


def by_cells(large: DataFrame, w: int, percent: int, region: int) -> tuple[DataFrame, DataFrame | None]:
    """(links, rows of _join_regions that hold the others) of large regions: node, packed, set_size, region.

    Every round cuts all large regions into Voronoi cells by tasks of about region sets each.
    """
    weight = lambda size, shingles: F.greatest(F.ceil(size / region), F.ceil(shingles / REGION_SHINGLES)).cast("int")
    current, links, ready = large.withColumns({"root": F.col("node"), "main": F.lit(False)}), [], []

    def measured(rows: DataFrame) -> DataFrame:
        """rows with size and blocks of their region, and main: whether a set is in its region's largest component."""
        by_root = rows.groupBy("region", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("set_size").alias("shingles"))
        of = by_root.groupBy("region").agg(F.sum("n").alias("size"), F.sum("shingles").alias("all"), F.max(F.struct("n", "root"))["root"].alias("top"), F.count(F.lit(1)).alias("roots"))
        of = materialize(of.select("region", "size", "top", "roots", weight(F.col("size"), F.col("all")).alias("blocks"), F.lit("").alias("none")), "cell-sizes", rows=0)
        met = rows.drop("main").join(broadcast_if_small(of, "none").drop("none"), "region").where("roots > 1")
        return met.withColumn("main", F.col("root") == F.col("top")).drop("top", "roots")

    current = materialize(measured(current), "large-regions")
    for _ in range(ROUNDS):
        slot = F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(PIVOTS))
        chosen = current.groupBy("region", slot.alias("slot")).agg(F.min(F.struct("main", F.xxhash64(F.lit(4), "node").alias("o"), "node"))["node"].alias("p"))
        chosen = materialize(chosen.select(F.col("region").alias("p_region"), "p", F.lit("").alias("none")), "pivots", rows=0)
        pivots = current.join(broadcast_if_small(chosen, "none"), (F.col("region") == F.col("p_region")) & (F.col("node") == F.col("p"))).select(F.col("region").alias("in"), F.col("node").alias("pivot"), F.col("packed").alias("text"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))
        own = current.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks").cast("long")).cast("int")).select("region", "block", "node", "packed", "set_size")
        cut = own.groupBy("region", "block").cogroup(pivots.groupBy("in", "at")).applyInArrow(lambda a, b: _assign(a, b, w, percent), "node long, packed binary, set_size long, region long, cells array<long>, near array<long>")
        cut = materialize(cut, "cells")
        links.append(materialize(cut.select("node", F.explode("near").alias("b")).where("node <> b").select(F.col("node").alias("a"), "b"), "cell-links"))
        every = reduce(DataFrame.unionByName, links)
        roots = connected_components(every, rows=every.count()).withColumnsRenamed({"node": "r_node", "root": "r_root"})
        before = current.count()
        known = lambda rows: rows.join(roots, F.col("node") == F.col("r_node"), "left").withColumn("root", F.coalesce("r_root", "node")).drop("r_node", "r_root")
        cells = materialize(measured(known(cut.select("node", "packed", "set_size", F.explode("cells").alias("region")))), "cells")
        if cells.count() > COPIES * before:  # pivots don't part these regions
            current = materialize(measured(known(cut.select("node", "packed", "set_size", "region"))), "large-regions")
            break
        ready.append(cells.where("blocks = 1"))
        discard(cut)
        current = cells.where("blocks > 1")
        now = current.count()
        if not now or now > 0.8 * before:
            break
    out = [x.select(F.pmod(F.xxhash64("region"), F.lit(256)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), "region", "node", "root", "packed") for x in ready]
    if not current.isEmpty():
        # Sets outside the main component, in blocks, meet all blocks.
        rest = current.where("NOT main").groupBy("region").agg(weight(F.count(F.lit(1)), F.sum("set_size")).alias("few")).withColumn("none", F.lit(""))
        both = current.join(broadcast_if_small(materialize(rest, "rest", rows=0), "none").drop("none"), "region")
        block = lambda n: F.pmod(F.xxhash64(F.lit(6), "node"), n.cast("long")).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        out.append(both.select(F.col("region").alias("g"), upto(F.col("few")).alias("i"), block(F.col("blocks")).alias("j"), "region", "node", "root", "packed"))
        out.append(both.where("NOT main").select(F.col("region").alias("g"), block(F.col("few")).alias("i"), upto(F.col("blocks")).alias("j"), "region", "node", "root", "packed"))
    return reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, out) if out else None


def jaccard_components(docs: DataFrame, w: int = SHINGLE, percent: int = PERCENT, region: int = REGION) -> DataFrame:
    """doc_id, k, n_shingles, node (of its set), root (one node of the component, null without shingles) and component_id: the least doc_id that links reach."""
    size = text_bytes(docs)
    n_buckets = buckets_for(size, BUCKET_BYTES)
    base = whole_ids(keyed(docs))
    lists = "doc_id array<long>, k array<long>, node array<long>, n array<long>"

    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(base, w))

    def agreements(docs: DataFrame) -> DataFrame:
        signed = docs.select("doc_id", "k", "region", "text").mapInArrow(lambda it: _signed(it, w, percent, n_buckets, often.value), f"bucket int, sig binary, nodes binary, {lists}")
        return materialize(signed.groupBy("bucket").applyInArrow(lambda t: _agree(t, n_buckets), f"part int, pairs binary, {lists}"), "agreements")

    def cut(met: DataFrame) -> DataFrame:
        """(node, region, size) of nodes that agree with another."""
        pairs = met.where("part IS NOT NULL").select("part", "pairs").groupBy("part").applyInArrow(_distinct_pairs, "a long, b long")
        pairs = materialize(pairs, "pairs")
        n = pairs.count()
        found = connected_components(pairs, rows=n).withColumnRenamed("root", "region")
        sizes = found.groupBy("region").agg(F.count(F.lit(1)).alias("size"))
        out = materialize(found.join(sizes, "region").select("node", "region", "size"), "regions", rows=n)
        discard(pairs)
        return out

    def brought(nodes: DataFrame, n: int, *size: str) -> DataFrame:
        """Texts of n nodes: one document of each brings the set."""
        bring = rows.join(nodes, "node").groupBy("node", "region", *size).agg(F.min(F.struct("doc_id", "k")).alias("d"))
        bring = materialize(bring.select(F.col("d.doc_id").alias("b_id"), F.col("d.k").alias("b_k"), "node", "region", *size, F.lit("").alias("none")), "bring", rows=n)
        return base.join(broadcast_if_small(bring, "none"), F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("k") == F.col("b_k"))).select("doc_id", "k", "text", "node", "region", *size)

    met = agreements(base.withColumn("region", F.lit(0).cast("long")))
    rows = met.where("part IS NULL").select(F.explode(F.arrays_zip("doc_id", "k", "node", "n")).alias("r")).select("r.*")
    regions = cut(met)
    # Regions that chance agreements hold together fall apart when they are cut again by classes of their own: first
    # all of them, so that few sets travel, then those that are still large.
    before = -1
    for level in range(LEVELS):
        again = F.col("size") > (region if level else 1)
        large = regions.where(again)
        # As many nodes in as many large regions as before: these hold together by links, not by chance.
        now = tuple(large.agg(F.count(F.lit(1)), F.count_distinct("region")).first())
        if not now[0] or now == before:
            break
        before = now if level else -1
        old, met_again = regions, agreements(brought(large, now[0], "size"))
        regions = materialize(old.where(~again).unionByName(cut(met_again)), "regions", rows=now[0])
        discard(old, met_again)
    n_left = regions.count()

    def measured(regions: DataFrame) -> DataFrame:
        """regions with set_size, and blocks: over 1 where a region is large."""
        sized = regions.join(rows.groupBy("node").agg(F.max("n").alias("set_size")), "node")
        weights = sized.groupBy("region").agg(F.sum("set_size").alias("weight"))
        blocks = F.greatest(F.ceil(F.col("size") / region), F.ceil(F.col("weight") / REGION_SHINGLES)).cast("int")
        return materialize(sized.join(weights, "region").select("node", "region", "size", "set_size", blocks.alias("blocks")), "sized", rows=n_left)

    def by_rarest(large: DataFrame, nodes: int, n_parts: int) -> DataFrame:
        """Agreements of nodes of large regions on one of their rarest shared shingles."""
        spread = brought(large.select("node", "region"), nodes).select("node", "region", "text").mapInArrow(lambda it: _spread(it, w, n_parts), "bucket int, sig binary, nodes binary")
        shared = spread.groupBy("bucket").applyInArrow(lambda t: _shared(t, n_parts), "part int, sig binary, of binary, times binary")
        shared = materialize(shared, "shared")
        in_part = large.select("node", "set_size", F.pmod("node", F.lit(n_parts)).cast("int").alias("p"))
        rare = shared.groupBy("part").cogroup(in_part.groupBy("p")).applyInArrow(lambda a, b: _rarest(a, b, percent, n_parts), "bucket int, sig binary, nodes binary")
        rare = rare.select("*", *(F.lit(None).cast("array<long>").alias(c) for c in ("doc_id", "k", "node", "n")))
        out = materialize(rare.groupBy("bucket").applyInArrow(lambda t: _agree(t, n_parts), f"part int, pairs binary, {lists}"), "agreements")
        discard(shared)
        return out

    sized, before = measured(regions), None
    for _ in range(RAREST):
        large = sized.where("blocks > 1").select("node", "region", "set_size")
        now = tuple(large.agg(F.count(F.lit(1)), F.count_distinct("region"), F.sum("set_size")).first())
        if not now[0] or now == before:
            break
        before, old, met_again = now, sized, by_rarest(large, now[0], buckets_for(now[2] * 24, BUCKET_BYTES))
        again = cut(met_again)
        sized = measured(old.where("blocks = 1").select("node", "region", "size").unionByName(again))
        discard(old, met_again, again)
    sets = brought(sized.select("node", "region", "set_size", "blocks"), n_left, "set_size", "blocks")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A compressed text takes a third of the bytes of its set, so texts travel and regions make the sets.
        press = zstandard.ZstdCompressor(level=3)
        names = ("node", "region", "set_size", "blocks")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array([press.compress(x.as_py().encode().lower()) for x in batch.column("text")], pa.binary())], names=[*names, "packed"])

    sets = sets.select("node", "region", "set_size", "blocks", "text").mapInArrow(packed, "node long, region long, set_size long, blocks int, packed binary")
    joined = lambda rows: rows.groupBy("g", "i", "j").applyInArrow(lambda t: _join_regions(t, w, percent), "a long, b long")
    group = ("region", "node", F.col("node").alias("root"), "packed")
    if sized.where("blocks > 1").isEmpty():
        links = joined(sets.select(F.pmod(F.xxhash64("region"), F.lit(n_buckets * 4)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), *group))
    else:
        sets = materialize(sets, "sets")
        links = joined(sets.where("blocks = 1").select(F.pmod(F.xxhash64("region"), F.lit(n_buckets * 4)).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j"), *group))
        more, rest = by_cells(sets.where("blocks > 1").select("node", "packed", "set_size", "region"), w, percent, region)
        links = links.unionByName(more) if rest is None else links.unionByName(more).unionByName(joined(rest))
    links = materialize(links, "links")
    roots = connected_components(links, rows=links.count())
    rows = rows.join(roots, "node", "left").withColumn("c", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    least = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"))
    return salted_join(rows, least, "c", ("doc_id", "k")).select("doc_id", "k", F.col("n").alias("n_shingles"), "node", F.col("c").alias("root"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 2, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 90 * (x.n + y.n - p.i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
