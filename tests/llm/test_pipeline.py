"""The corpus pipeline and its stages against brute force."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from ruleweave.llm import bpe, quality_classifier

WORDS = [f"word{i}" for i in range(300)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus():
    rng = np.random.default_rng(21)
    say = lambda n: " ".join(rng.choice(WORDS, n).tolist())
    item, shared, near = say(30), "Subscribe NOW to our letter", say(120).split()
    docs = []
    for i in range(90):
        text = "\n".join(say(int(rng.integers(20, 50))) for _ in range(3))
        if i % 4 == 0:
            text += f"\n  {shared.upper() if i % 8 else shared} "
        if i % 10 == 3:
            text = " ".join(item.split()[3:20]) + "\n" + " ".join(text.split()[:40])
        if i % 6 == 1:
            text += " junkword spamword" * 12
        docs.append((i, text, "en", f"s{i % 3}"))
    for i in range(100, 112):  # near copies of one another
        words = list(near)
        words[int(rng.integers(120))] = f"changed{i}"
        docs.append((i, " ".join(words), "en", "copies"))
    docs += [(200, docs[5][1], "en", "exact"), (201, None, "en", "x"), (202, "", None, "x"), (203, " \n ", "en", "x"), (None, docs[6][1], "en", "no id"), (None, docs[6][1], "en", "no id")]
    docs += [(300, say(60), "en", "b"), (None, docs[-1][1], "en", "x")]
    docs += [docs[-2][:3] + ("a",), (-5, " ".join(near) + " Été", "fr", "x"), (400, item, "en", "x"), (401, "alone " * 2000 + say(40), "en", "long")]
    return [(*d, len(d[1]) if d[1] is not None else None) for d in docs], item


def labels():
    return [(i, int(i % 6 != 1), int(i == 7)) for i in range(70)] + [(None, 1, 0), (5000, 0, 0), (3, None, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs, item = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels(), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def without_common_lines(rows):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for i, t in {(r[0], r[1]) for r in rows} for k in {key(x) for x in (t or "").split("\n")} if k)
    cut = lambda t: "\n".join(x for x in (t or "").split("\n") if not (key(x) and n[key(x)] >= 10))
    return [(i, cut(t), lang, source, len(cut(t))) for i, t, lang, source, _ in rows]


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    own, group = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return [g if own[i] else None for i, g in enumerate(group)]


def contaminated(text, item):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, b, hit = find(text), find(item), set()
    windows = {tuple(b[s : s + 13]) for s in range(len(b) - 12)}
    for s in range(len(w) - 12):
        if tuple(w[s : s + 13]) in windows:
            hit |= set(range(s, s + 13))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, sf_dir):
    """Each stage on all that its predecessor kept, against brute force; the classifier's own weights have a test of their own."""
    docs, item = corpus()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality_classifier.resample(start, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {(r.doc_id, r.k): r.kept for r in judged.collect()}
    keyed = {tuple(r)[:2]: r.k for r in start.selectExpr("doc_id", "text", "xxhash64(17, doc_id, text) AS k").collect()}
    stage = dict(corpus_pipeline.STAGES)
    good = rows_of(stage["quality classifier"](spark, start, sf_dir))
    assert Counter(good) == Counter(r for r in docs if kept[r[0], keyed[r[:2]]]) and 0 < len(good) < len(docs)
    assert sum(r[0] in range(1, 70, 6) for r in good) <= 1
    # The other stages take all documents here, so that every case passes through each of them.
    lines = without_common_lines(docs)
    assert Counter(rows_of(stage["line dedup"](spark, start, sf_dir))) == Counter(lines) and lines != docs
    once = rows_of(stage["n-gram Jaccard join"](spark, start, sf_dir))
    found, group = Counter(once), groups(docs)
    assert not found - Counter(docs)
    for g in set(group) - {None}:
        own = sorted({docs[i] for i in range(len(docs)) if group[i] == g}, key=lambda r: (r[0] is None, r[0] or 0, str(r[3])))
        assert sum(found[r] for r in own) == 1 and sum(found[r] for r in own if r[0] == own[0][0]) == 1
    assert found[next(r for r in docs if r[0] == 300 and r[3] == "a")] == 1
    assert all(found[r] == n for r, n in Counter(r for r, g in zip(docs, group, strict=True) if g is None).items())
    clean = rows_of(stage["benchmark decontamination"](spark, start, sf_dir))
    assert Counter(clean) == Counter(r for r in docs if not contaminated(r[1], item)) and len(clean) < len(docs)


def test_run(spark, sf_dir):
    """run() is its stages one after the other, on what is left; the last gives what the tokenizer's library gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(rows_of(stage(spark, docs, sf_dir)), COLUMNS)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    import hashlib

    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter()
    for i, t, *_ in rows_of(docs):
        ids = plain.encode_ordinary(t or "")
        want[i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(want) > 20


def test_empty_corpus(spark, tmp_path):
    for name, schema in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
