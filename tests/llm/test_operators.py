"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleweave.llm import bpe, decontaminate, jaccard_join, language_id, line_dedup, quality_classifier, quality_rules, quotations, substring_dedup, training_order
from ruleweave.llm.common import word_runs
from ruleweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, k long, h string, lines int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts():
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(WORDS, n).tolist())
    passage, out = say(60), []
    for i in range(40):
        body = say(int(rng.integers(1, 120)))
        if i % 5 == 0:
            body += "\n" + passage
        if i % 4 == 0:
            body += "\n  A shared LINE\t\n\n"
        out.append((i, body))
    out += [(100 + i, out[3][1] + (" extra" * (i % 3))) for i in range(12)]
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "Été ÀÉ É naïve\x1cword '"), (None, "no id " + passage), (204, "x " * 5000), (205, out[7][1]), (205, out[7][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "h", 2) for i, t in texts()], SCHEMA).repartition(3).persist()


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_line_dedup(docs, limit):
    split = {(i, t): (t or "").split("\n") for i, t in texts()}
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for lines in split.values() for k in {key(x) for x in lines})
    want = Counter()
    for i, t in texts():
        kept = [x for x in split[i, t] if not (key(x) and n[key(x)] >= 10)]
        want[i, len(split[i, t]), len(split[i, t]) - len(kept), "\n".join(kept)] += 1
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs, limit=limit).collect())
    assert got == want and any(r[2] for r in want)


def test_word_runs():
    data = " ".join(f"word{i}" for i in range(500)).encode() + b"\t\n" + b"x" * 300 + b" end "
    for size in (1, 7, 64, 10_000):
        runs = list(word_runs(data, size))
        assert [w for r in runs for w in r] == data.split() and (size > 64 or len(runs) > 20)
    assert list(word_runs(b"")) == []


@pytest.mark.parametrize(("window", "block"), [(20, 400_000), (3, 400_000), (20, 100), (3, 7)])
def test_substring_dedup(docs, window, block):
    rows = sorted(set(texts()), key=lambda r: (r[0] is None, r[0] or 0))
    seen, gone = set(), defaultdict(set)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in seen:
                gone[i, t] |= set(range(s, s + window))
            seen.add(g)
    want = Counter((i, len(words(t)), len(gone[i, t]), " ".join(w for p, w in enumerate(words(t)) if p not in gone[i, t])) for i, t in texts())
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(docs, window, block).collect())
    assert got == want and any(gone.values())


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("singles", [False, True])
def test_decontamination(spark, docs, most, singles):
    odd = "\u1c89" * 12 + " É a\u0130b ǅ one two three four five six seven eight nine"  # cased otherwise by each library
    items = [(1, " ".join(words(texts()[5][1])[:20])), (2, "Alpha beta"), (3, ""), (None, "gamma delta"), (4, None), (2, "alpha BETA"), (5, odd), (6, "É alpha"), (7, "é")]
    items += [(8, "Extra"), (9, "x"), (10, "tau")] if singles else []
    more = [(700, odd), (701, odd.replace("É", "é")), (702, "before " + odd.upper().replace("A", "a") + " after"), (703, "é É alpha EXTRA"), (704, odd + "\n" + odd)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("word", F.lit(1)).withColumn("item_id", F.lit("x"))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    want = Counter()
    for i, t in texts() + more:
        w, hit, got = find(t), set(), set()
        for item, b in items:
            b = find(b)
            n = min(13, len(b))
            windows = {tuple(b[s : s + n]) for s in range(len(b) - n + 1)} if b else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    got |= {str(item)} if item is not None else set()
        want[i, len(w), tuple(sorted(hit)), tuple(sorted(got)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    done = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit(0)), max_windows=most)
    assert Counter((r.doc_id, r.n_words, tuple(r.hit), tuple(r["items"]), r.contaminated) for r in done.collect()) == want
    assert sum(n for (i, _, hit, *_), n in want.items() if i == 700 and len(hit) == 13) == 1


def sets(t, w):
    x = words(lower(t))
    return frozenset(tuple(x[s : s + w]) for s in range(max(1, len(x) - w + 1))) if x else frozenset()


@pytest.mark.parametrize(("w", "percent", "region"), [(3, 90, 4096), (3, 60, 3), (1, 80, 8)])
def test_jaccard_join(docs, w, percent, region):
    rows = texts()
    own = [sets(t, w) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= percent * len(own[i] | own[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[i][0], len(own[i]), least[group[i]] if own[i] else rows[i][0]) for i in range(len(rows)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, w, percent, region).collect())
    assert got == want


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (7, 8), (9, 9), (5, None), *((i, i + 1) for i in range(20, 60))]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} | {i: 20 for i in range(20, 61)}


def test_bpe(docs):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in texts())
    done = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in done.collect()) == want


def test_merges_are_those_of_the_library():
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(11)
    tokens = list(ranks)
    words_ = [b"a", b"aaaaaaaaa", b" the", "ÀÉ日本".encode(), b"x" * 5000, bytes(range(256))]
    words_ += [b"".join(tokens[int(i)] for i in rng.integers(0, 3000, int(n))) for n in rng.integers(1, 40, 400)]
    for word in words_:
        try:
            text = word.decode()
        except UnicodeDecodeError:
            assert b"".join(tokens_of(ranks)[i] for i in bpe.merge(word, ranks)) == word
            continue
        assert bpe.merge(word, ranks) == plain.encode_ordinary(text), word


def tokens_of(ranks):
    return {i: b for b, i in ranks.items()}


def test_quality_counts(docs):
    want = Counter()
    for i, t in texts():
        w = words(t)
        at = defaultdict(list)
        for s in range(len(w) - 2):
            at[tuple(w[s : s + 3])].append(s)
        repeat = {s + j for starts in at.values() if len(starts) > 1 for s in starts for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)] += 1
    got = quality_rules.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_triples_are_told_apart():
    rng = np.random.default_rng(5)
    for n in (3, 2_000_000, 4_000_000):
        ids = np.concatenate((rng.integers(0, n, 200), np.arange(20) % 3)).astype(np.uint64)
        got = quality_rules.triples(ids, n).tolist()
        want = [tuple(ids[i : i + 3].tolist()) for i in range(len(ids) - 2)]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(got)) for j in range(i))


def test_divergence_by_brute_force(spark):
    """Distances, limits and verdicts; two languages of other scripts and words under one label are told apart."""
    rng = np.random.default_rng(17)
    tongues = {"xx": [f"mot{i}" for i in range(60)], "yy": [f"слово{i}" for i in range(60)], "zz": [f"言葉{i}" for i in range(40)]}
    rows = [(i, " ".join(rng.choice(tongues[g], int(rng.integers(100, 160)), p=np.arange(len(tongues[g]), 0, -1) / np.arange(len(tongues[g]) + 1).sum())), g) for i, g in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(900, " ".join(rng.choice(tongues["yy"], 150)), "xx"), (901, " ".join(f"other{i}" for i in range(150)), "xx"), (902, None, "xx"), (903, "short", None), (904, "| # % " * 60, "yy"), (905, " ".join(f"odd{i}" for i in range(120)) + " 𠀀𠀁😀", None)]
    plain = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w).strip(".,;:!?'\"()")
    held, n_docs = defaultdict(Counter), Counter(g for *_, g in rows)
    for _, t, g in rows:
        held[g].update({plain(w) for w in (t or "").split()})
    common = {g: [w for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0].encode())) if w and n >= 0.01 * n_docs[g]][:150] for g, c in held.items()}
    share = lambda x: np.array(x) / max(1, sum(x))
    words_of = {i: share([sum(plain(w) == c for w in (t or "").split()) for c in common[g]] + [0] * (150 - len(common[g])) + [sum(plain(w) not in common[g] for w in (t or "").split())]) for i, t, g in rows}
    classes_of = {i: share([sum(quality_rules._class(ord(c)) == k if ord(c) < 0x10000 else quality_rules.CLASSES[k] == ("Han" if ord(c) >= 0x20000 else "other") for c in t or "") for k in range(len(quality_rules.CLASSES))]) for i, t, _ in rows}
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    passing = {i for i in got if not got[i].base_failed}

    def apart(p, q):
        m = (p + q) / 2
        return np.sqrt(max(0, sum(x * np.log2(x / z) for x, z in zip(p, m, strict=True) if x) / 2 + sum(y * np.log2(y / z) for y, z in zip(q, m, strict=True) if y) / 2))

    far = {}
    for g in n_docs:
        own = [i for i, _, x in rows if x == g and i in passing]
        for i, t, x in rows:
            if x == g and own:
                far[i] = tuple(apart(of[i], np.mean([of[j] for j in own], 0)) if n >= least else None for of, n, least in ((classes_of, sum(not c.isspace() for c in t or ""), 200), (words_of, len((t or "").split()), 100)))
        spread = sorted(int(far[i][1] * 1000) for i in own if far[i][1] is not None)
        if spread:
            low, mid = (spread[-(-len(spread) * k // 4) - 1] for k in (1, 2))
            limit = max(0.36, (mid + 0.5 + 2.5 * (mid - low)) / 1000)
            for i, _, x in rows:
                if x == g:
                    assert abs(got[i].word_limit - limit) < 1e-9
                    assert got[i].kept == (i in passing and (far[i][0] or 0) <= 0.22 and (far[i][1] or 0) <= limit)
    for i, (a, b) in far.items():
        for x, y in ((got[i].class_distance, a), (got[i].word_distance, b)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6)
    assert sum(got[i].kept for i in range(120)) >= 117 and not any(got[i].kept for i in (900, 901, 902, 904))


def test_distance(spark):
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    want = np.sqrt(sum(a * np.log2(a / c) for a, c in zip(p, m, strict=True) if a) / 2 + sum(a * np.log2(a / c) for a, c in zip(q, m, strict=True) if a) / 2)
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    assert abs(df.select(quality_rules.distance(F.col("p"), F.col("q"))).first()[0] - want) < 1e-9


def test_classifier_keeps_good_and_drops_bad(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS, 80)) + (" rubbish junk rubbish" * 3 if i % 4 == 0 else ""), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (None, "alpha beta", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 300)] + [(None, 1, 0), (5000, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_classifier.resample(docs, labels).collect()}
    assert len(got) == 403
    assert sum(got[i] for i in range(400) if i % 4) >= 297 and sum(got[i] for i in range(0, 400, 4)) <= 3
    assert all(r.kept for r in quality_classifier.resample(docs, labels.limit(0)).collect())


def test_classifier_learns_from_rare_one_sided_words(spark):
    rng = np.random.default_rng(4)
    toxic = lambda i: i % 25 == 0
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS, 40)) + (" vile" if toxic(i) else "")) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(toxic(i))) for i in range(600)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality_classifier.resample(docs, labels).collect()}
    assert sum(kept[i] for i in kept if toxic(i)) <= 2 and sum(kept[i] for i in kept if not toxic(i)) >= 0.95 * 576


def test_weights_and_sampling_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(WORDS[: 4 + i % 5], 30 + i % 40)) + " vile vile" * (i % 9 == 0) * (1 + i % 5)) for i in range(200)] + [(500, None), (501, ""), (7, "alpha beta"), (7, "alpha beta"), (None, "tau tau")]
    labels = [(i, int(i % 9 > 0), int(i % 9 == 0)) for i in range(0, 150)]
    good = {i for i, q, t in labels if q == 1 and not t}
    grams = lambda t: (t or "").split() + list(zip((t or "").split(), (t or "").split()[1:], strict=False))
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(set(grams(t)))
        target.update(set(grams(t)) if i in good else ())
    ratio = {}
    for part in (str, tuple):
        own = sorted((target[g] / raw[g], g) for g in raw if isinstance(g, part))
        half, upto = sum(raw[g] for _, g in own) / 2, 0
        for usual, g in own:
            upto += raw[g]
            if upto >= half:
                break
        for _, g in own:
            e = raw[g] * usual
            far = (abs(target[g] - e) / np.sqrt(e + 1) / quality_classifier.SIGMAS) ** 8
            ratio[g] = np.log((target[g] + quality_classifier.PRIOR) / (e + quality_classifier.PRIOR)) * far / (1 + far)
    total = lambda t: sum(ratio[g] for g in grams(t))
    judged = [(total(t), len(grams(t)), i in good) for i, t in rows if i is not None and i < 150 and t]
    offset, each = quality_classifier.best_offset(judged)
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = {(i, t): total(t) + offset + each * len(grams(t)) for i, t in rows}
    for k, temperature in ((None, 1.0), (0, 1.0), (1, 1.0), (40, 1.0), (10_000, 1.0), (None, 0.1), (40, 0.1)):
        got = quality_classifier.resample(docs, labelled, k=k, temperature=temperature, sample=10**9).collect()  # no two labels share a slot
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        for r in got:
            assert any(i == r.doc_id and abs(w - r.log_weight) < 1e-3 and len(grams(t)) == r.n_grams for (i, t), w in text.items())
        noise = np.array([r.key - r.log_weight / temperature for r in got])
        assert abs(noise.mean() - 0.5772) < 0.4 and abs(noise.std() - 1.2825) < 0.4
        n = sum(w > 0 for w in (text[i, t] for i, t in rows)) if k is None else min(k, len(rows))
        least = sorted((r.key for r in got), reverse=True)[n - 1] if n else np.inf
        assert all(r.kept == (r.key >= least) for r in got) and sum(r.kept for r in got) in (n, n + 1)


def test_labelled_sample_is_full_and_bounded(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(3000)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    for size, full in ((50, True), (500, True), (5000, False)):
        got = quality_classifier.labelled_sample(labels, size).collect()
        for good, most in ((True, 1800), (False, 1200)):
            n = sum(r.good == good for r in got)
            assert n == size if full else 0.9 * most < n <= most
        assert all(r.good == (r.l_id % 3 > 0 and r.l_id % 10 > 0) for r in got) and len({r.l_id for r in got}) == len(got)


def test_kth_largest(spark):
    keys = np.random.default_rng(1).normal(size=5000).round(2)
    df = spark.createDataFrame([(float(x),) for x in keys], "key double")
    for k in (1, 17, 2500, 5000):
        assert quality_classifier.kth_largest(df, k, bins=16, few=10) == sorted(keys, reverse=True)[k - 1]


def test_network_slopes_and_languages(spark):
    net = language_id.Network(["a", "b"], hidden=3)
    strips, target = language_id.strips_of(b"some text of letters", 10).T, np.array([0, 1])
    _, grad = net.gradient(strips, target)
    for name in net.p:
        at = (strips[2, 0], 1) if name[0] == "x" else tuple(0 for _ in net.p[name].shape)
        old, loss = net.p[name][at], []
        for step in (1e-2, -1e-2):
            net.p[name][at] = old + step
            loss.append(net.gradient(strips, target)[0])
        net.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[name][at]) < 2e-3 + 0.05 * abs(grad[name][at])
    rng = np.random.default_rng(2)
    make = {"en": "the of and that with from".split(), "de": "der die und nicht über schön".split()}
    rows = [(i, " ".join(rng.choice(make[lang], 40)), lang, 0) for i in range(120) for lang in make] + [(500, None, "en", 0), (501, "12 34", "de", 0), (502, "und", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = language_id.train(docs.where("doc_id % 3 != 1"), steps=60)
    got = [(r.doc_id, r.text, r.lang_pred, r.score) for r in language_id.predict(docs, net).collect()]
    want = Counter((i, t) for i, t, *_ in rows)
    assert Counter((i, t) for i, t, *_ in got) == want and all(0 <= s <= 1 for *_, s in got)
    assert {lang for i, _, lang, _ in got if i in (500, 501)} == {"und"}
    truth = {t: lang for i, t, lang, _ in rows if lang and t}
    held = [(t, lang) for i, t, lang, _ in got if i % 3 == 1 and i < 500]
    assert sum(truth[t] == lang for t, lang in held) >= 0.95 * len(held)
    assert all(r.lang_pred == "und" for r in language_id.predict(docs, None).collect())


def test_every_language_is_learned_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id.Network, "fit", lambda self, strips, target, steps: seen.append((strips, target, steps)))
    header = "licence " * 400
    rows = [(header + f"body{j} " * 3000, "en") for j in range(5)] + [("short text", f"l{i:02}") for i in range(70)] + [("no label", None)]
    net = language_id.train(spark.createDataFrame(rows, "text string, lang string"), train_strips=16)
    strips, target, steps = seen[0]
    assert net.labels == ["en", *(f"l{i:02}" for i in range(70))] and steps == 300 * 18
    assert Counter(target.tolist()) == {0: 16} | {i: 1 for i in range(1, 71)}
    held = [bytes(x[x < 256].astype(np.uint8)) for x in strips[target == 0]]
    assert sum(b"body" in x for x in held) >= 12 and all(len(x) == 256 for x in held)


def test_training_order(spark, docs):
    for n in (1, 2, 5, 64, 1000):
        assert sorted(training_order.slots(np.arange(n), n).tolist()) == list(range(n))
    path = training_order.write_shards(docs, seq_len=100, per_shard=7)
    got = training_order.read_shards(spark, path, 100, 7).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    back = defaultdict(dict)
    for r in got:
        assert r.shard == r.slot // 7 and r.offset == r.slot % 7 * 117 and len(r.tokens) == r.n_tokens
        back[r.doc_id][r.seq_no] = bytes(r.tokens)
    assert {i: b"".join(v for _, v in sorted(x.items())) for i, x in back.items()} == {i: t.encode() for i, t in texts() if t}
    assert sorted(r.slot for r in training_order.read_shards(spark, path, 100, 7, start=10).collect()) == list(range(10, len(got)))


@pytest.mark.parametrize("width", [2, 4])
def test_training_order_of_token_ids(spark, docs, width):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = {(r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect() if r.n_tokens}
    rows = [(i, np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes(), "x") for i, x in sorted(ids, key=str)]
    df = spark.createDataFrame([*rows, rows[0], (None, None, "x"), (1000, b"", "x")], "doc_id long, tokens binary, data string")
    path = training_order.write_shards(df, seq_len=16, per_shard=50, ids="tokens", width=width)
    got = training_order.read_shards(spark, path, 16, 50, width=width).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) == list(range(sum(-(-len(x) // (16 * width)) for _, x, _ in rows)))
    back = defaultdict(bytes)
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.seq_no)):
        assert len(r.tokens) == r.n_tokens * width and r.offset == r.slot % 50 * (16 + 16 * width + 1)
        back[r.doc_id] += bytes(r.tokens)
    assert {i: x for i, x, _ in rows if i != 205} == {i: x for i, x in back.items() if i != 205}


def test_ids_of_other_types_are_refused(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for run in (substring_dedup.dedup_substrings, jaccard_join.jaccard_components, training_order.write_shards):
        with pytest.raises(TypeError):
            run(docs)


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Shall we meet?\nAt noon."),
        (1, 1, "assistant", "> shall we  meet?\nYes.\n"),
        (1, 2, "user", ">> Shall we meet?\n> Yes.\nGood."),
        (2, 0, "user", "> Good.\nI saw that."),
        (2, 1, None, None),
        (2, None, "user", "lost"),
        (3, 0, "user", "> never said\n"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 6
    pick = lambda c, t: (got[c, t].own_text, got[c, t].max_level, got[c, t].n_quotes, got[c, t].n_linked, got[c, t].parent_conv, got[c, t].parent_turn)
    assert pick(1, 1) == ("Yes.", 1, 1, 1, 1, 0)
    assert pick(1, 2) == ("Good.", 2, 2, 2, 1, 1)
    assert pick(2, 0) == ("I saw that.", 1, 1, 1, 1, 2)
    assert pick(2, 1) == ("", 0, 0, 0, 2, 0)
    assert pick(3, 0) == ("", 1, 1, 0, None, None)


def test_partial_quotations(spark):
    rows = [
        (1, 0, "user", "Alpha one.\nBeta two.\nGamma three."),
        (1, 1, "assistant", "First part.\n\nSecond part.\n\nThird part."),
        (1, 2, "user", "Between."),
        (1, 3, "user", "> Beta two.\n> gamma  three.\nSo?"),
        (1, 4, "user", "> First part.\n>\n> Second part.\nFine."),
        (1, 5, "user", "> Alpha one.\n> [...]\n> Gamma three.\nAnd?"),
        (1, 6, "user", "> Said later.\nHm."),
        (1, 7, "user", "Said later."),
        (2, 0, "user", "Said later."),
        (3, 0, "user", "> Beta two.\n> First part.\n> Not said.\nMixed."),
    ]
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_conv, r.parent_turn) for r in quotations.link(spark.createDataFrame(rows + rows[3:4], "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 3] == (1, 1, 1, 0) and got[1, 4] == (1, 1, 1, 1) and got[1, 5] == (1, 1, 1, 0)
    assert got[1, 6] == (1, 1, 2, 0)
    assert got[3, 0][1] == 1 and got[3, 0][2] == 1


def linked_by_brute_force(rows):
    """(conv_id, turn, own_text, position, n_quotes, n_linked, parent_conv, parent_turn) of messages whose turns differ or which are equal."""
    convs = defaultdict(list)
    for r in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        convs[r[0]].append((*r, *quotations.parse(r[3])))
    lengths = sorted({len(quotations.solid(y)) for ms in convs.values() for m in ms for _, x in m[5] for y in quotations.parts(x)} - {0, 1})
    said = {(c, i): set(quotations.sayings(m[4], lengths)) for c, ms in convs.items() for i, m in enumerate(ms)}
    reply, linked = {}, {}
    for (c, i), _ in said.items():
        turn, passages = convs[c][i][1], convs[c][i][5]
        found = []
        for level, x in passages:
            for _, h in quotations.pieces(x):
                own = min((j for j in range(len(convs[c])) if h in said[c, j]), default=None)
                if own is not None and convs[c][own][1] < turn:
                    found.append((level, (c, own)))
                    break
                if away := [k for k in said if k[0] != c and h in said[k]]:
                    found.append((level, min(away)))
                    break
        linked[c, i] = len(found)
        reply[c, i] = next((at for level, at in found if level == 1), None)
    core = {(c, at[0]) for (c, _), at in reply.items() if at and at[0] != c}
    while (rest := {(a, b) for a, b in core if a in {y for _, y in core} and b in {x for x, _ in core}}) != core:
        core = rest
    circle = {a for a, _ in core}
    reply = {k: None if at and at[0] > k[0] and {k[0], at[0]} <= circle else at for k, at in reply.items()}
    up = {(c, i): reply[c, i] or ((c, i - 1) if i else None) for c, i in said}
    out = []
    for c, ms in convs.items():
        place = {}
        for i in range(len(ms)):
            seen, at = [], (c, i)
            while at and at[0] == c:
                seen.append(at[1])
                at = up[at]
            place[i] = (seen[-1], len(seen), i)
            while at:  # no circle
                assert len(seen) < len(said) + 2
                seen.append(at)
                at = up[at]
        position = {i: n + 1 for n, i in enumerate(sorted(place, key=place.get))}
        out += [(c, ms[i][1], ms[i][4], position[i], len(ms[i][5]), linked[c, i], *((up[c, i][0], convs[up[c, i][0]][up[c, i][1]][1]) if up[c, i] else (None, None))) for i in range(len(ms))]
    return Counter(out), bool(circle), max((n for *_, n, _, _ in out), default=0)


@pytest.mark.parametrize("seed", range(3))
def test_random_threads(spark, seed):
    rng = np.random.default_rng(seed)
    lines = [f"{a} {b}" for a in WORDS[:5] for b in WORDS[5:9]]
    rows, texts_of = [], []
    for c in range(12):
        for turn in range(int(rng.integers(1, 9))):
            own = [str(x) for x in rng.choice(lines, int(rng.integers(0, 4)))]
            quoted = []
            for _ in range(int(rng.integers(0, 3))):
                source = texts_of[int(rng.integers(len(texts_of)))] if texts_of and rng.random() < 0.7 else [str(rng.choice(lines))]
                quoted += [">" * int(rng.integers(1, 3)) + " " + x.upper() for x in source] + ["so"] * int(rng.integers(0, 2))
            texts_of.append(own)
            rows.append((c, turn, str(rng.choice(["user", "bot"])), "\n".join(quoted + own)))
    rows += rows[3:6] + [(2, None, "user", "lost"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("place"), F.lit("x").alias("h"))
    got = Counter((r.conv_id, r.turn, r.own_text, r.position, r.n_quotes, r.n_linked, r.parent_conv, r.parent_turn) for r in quotations.link(df).collect())
    want, circles, most = linked_by_brute_force(rows)
    assert got == want and most and (circles or seed)


def test_empty_tables(spark):
    import public_tokenizers

    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = [
        line_dedup.dedup_lines(none), substring_dedup.dedup_substrings(none), jaccard_join.jaccard_components(none), bpe.decode(bpe.encode(none, ranks, public_tokenizers.PATTERN), ranks),
        quality_rules.judge(none), quality_classifier.resample(none, labels), language_id.predict(none, language_id.train(none)), decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")),
        training_order.read_shards(spark, training_order.write_shards(none)), quotations.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    assert [df.count() for df in found] == [0] * len(found)

