"""The exact split of the Jaccard join: linked sets share a signature."""

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from ruleweave.llm.jaccard_join import Classes, _agree, _join_regions, _rarest, _shared, _spread, by_cells, jaccard_components
from ruleweave.sources.shared import written


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.97])
def test_linked_sets_share_a_signature_however_many_shingles_are_frequent(percent: int, share: float) -> None:
    draw = np.random.default_rng(percent)
    common = np.sort(draw.integers(0, 1 << 63, 5000).astype(np.uint64))
    classes = Classes(percent, common)
    for n in [1, 2, 4, 5, 6, 9, 10, 11, 20, 37, 64, 150, 400] * 8:
        a = np.unique(np.concatenate((draw.choice(common, int(n * share), replace=False), draw.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64))))
        out = int(draw.integers(0, len(a) * (100 - percent) // 100 + 1))
        b = draw.choice(a, len(a) - out, replace=False)
        while 100 * len(b) >= percent * (len(a) + 1) and draw.random() < 0.5:
            more = np.unique(np.append(b, draw.integers(0, 1 << 63, 1).astype(np.uint64)))
            if 100 * len(np.intersect1d(a, more)) < percent * len(np.union1d(a, more)):
                break
            b = more
        b = np.sort(b)
        assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
        if len(a) != len(b) or (a != b).any():
            assert np.intersect1d(classes.signatures(a), classes.signatures(b)).size


def near_copies(seed: int) -> list[tuple[int, str]]:
    """Groups of near copies, chains in which only neighbours link, and texts of their own."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(2000)]
    say = lambda n: rng.choice(words, n).tolist()
    out = []
    for n in (90, 60):
        base = say(60)
        for _ in range(n):
            own = list(base)
            for i in rng.integers(0, 60, int(rng.integers(0, 4))):
                own[int(i)] = str(rng.choice(words))
            out.append(own)
    chain = say(160)
    out += [chain[i : i + 60] for i in range(0, 100, 3)] + [say(40) for _ in range(40)]
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 80), (2, 60), (3, 90)])
def test_large_regions_are_cut_into_cells(spark, seed, percent):
    rows = near_copies(seed)
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(i for i, x in enumerate(group) if x == g) for g in set(group)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 3, percent, region=12).collect()}
    assert got == {i: least[g] for i, g in enumerate(group)}


@pytest.mark.parametrize("alike", [True, False])
def test_cells_alone_find_all_links(spark, alike):
    """One region of all texts; with nothing alike, pivots part nothing and all blocks meet."""
    rows = near_copies(7) if alike else [(i, " ".join(f"x{i}_{j // 2}" if j % 2 else "and" for j in range(40))) for i in range(60)] + [(100, " ".join(f"x3_{j // 2}" if j % 2 else "and" for j in range(41)))]
    sets = {i: frozenset(zip(w, w[1:], w[2:], strict=False)) for i, w in ((i, t.split()) for i, t in rows)}
    press = zstandard.ZstdCompressor().compress
    region = spark.createDataFrame([(i, press(t.encode()), len(sets[i]), 1) for i, t in rows], "node long, packed binary, set_size long, region long")
    links, rest = by_cells(region, 3, 80, 12)
    found = [tuple(r) for r in links.collect()]
    if rest is not None:
        found += [tuple(r) for r in rest.groupBy("g", "i", "j").applyInArrow(lambda t: _join_regions(t, 3, 80), "a long, b long").collect()]
    assert all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in found)

    def parts(links):
        group = {i: i for i in sets}
        for a, b in links:
            x, y = group[a], group[b]
            group = {i: y if g == x else g for i, g in group.items()}
        return {frozenset(i for i in group if group[i] == g) for g in set(group.values())}

    assert parts(found) == parts((a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))


@pytest.mark.parametrize("percent", [80, 90])
def test_rarest_shingles_keep_links_and_part_what_meets_by_chance(percent):
    """Of one region, linked sets stay together; texts that share a fifth of their shingles with others fall out."""
    rng = np.random.default_rng(percent)
    phrases = [" ".join(f"c{i}_{j}" for j in range(12)) for i in range(30)]
    alone = [" ".join([f"u{i}_{j}" for j in range(160)] + [phrases[int(p)] for p in rng.integers(0, 30, 3)]) for i in range(50)]
    texts = [t for _, t in near_copies(percent)] + alone
    sets = [frozenset(zip(w, w[1:], w[2:], strict=False)) for w in (t.split() for t in texts)]
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert linked
    n_parts, half = 3, len(texts) // 2
    batch = lambda ids: pa.RecordBatch.from_pydict({"node": list(ids), "region": [5] * len(ids), "text": [texts[i] for i in ids]})
    spread = pa.Table.from_batches(_spread(iter([batch(range(half)), batch(range(half, len(texts)))]), 3, n_parts))
    of = lambda t, c, i: t.filter(pa.array([x == i for x in t.column(c).to_pylist()], pa.bool_()))
    shared = pa.concat_tables(_shared(x, n_parts) for i in range(n_parts) if (x := of(spread, "bucket", i)).num_rows)
    sizes = lambda i: pa.table({"node": list(range(i, len(texts), n_parts)), "set_size": [len(sets[x]) for x in range(i, len(texts), n_parts)]})
    rare = pa.concat_tables(_rarest(of(shared, "part", i), sizes(i), percent, n_parts) for i in range(n_parts))
    pairs = [x for i in range(n_parts) if (y := of(rare, "bucket", i)).num_rows for x in _agree(y, n_parts).column("pairs").to_pylist()]
    group = list(range(len(texts)))
    for a, b in np.concatenate([np.frombuffer(x, np.int64) for x in pairs]).reshape(-1, 2).tolist():
        group = [group[b] if g == group[a] else g for g in group]
    assert all(group[a] == group[b] for a, b in linked)
    assert all(group.count(group[i]) == 1 for i in range(len(texts) - 50, len(texts)))


def test_written_tables_have_no_checksum_files(spark):
    """Hadoop starts a process for each, which counts with all of the JVM's memory while it starts."""
    import os

    t = written(spark.range(20).repartition(2))
    names = os.listdir(t._written.removeprefix("file://"))
    assert t.count() == 20 and not [x for x in names if x.endswith(".crc")]
