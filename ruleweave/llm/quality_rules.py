"""Quality rules: counts of words, symbols and repetition, and divergence from the document's language.

A document's histograms of character classes and of common words are compared with its language's by Jensen-Shannon
distance (the square root of the divergence in bits, 0 to 1). A language is a value of lang, whatever it is called: its
common words are those that most of its documents hold, its histograms the means over all its documents that pass the
count rules. A document is far in words from WORD_SPREAD times the lower half of the spread of its language's distances
above their median (MAX_WORD_DISTANCE at least), and far in classes from MAX_CLASS_DISTANCE. Texts below a minimum
length are not compared. Everything is counted over all documents; of the language's words WORDS_EACH at most are common.

Cases: a null text has no words; very long texts are read whole; null and repeated doc_ids are rows like any other; a
null lang is a language of its own; of words that as many documents hold the first in order of bytes are common; a
language none of whose documents passes the count rules has no reference, so its documents aren't compared; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .substring_dedup import Rolling

#: First code points of the blocks of scripts, each with the name of its class of letters.
SCRIPTS = (
    (0x250, "letter"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, "letter"),
    (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, "letter"), (0xB80, "Tamil"), (0xC00, "Telugu"),
    (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, "Sinhala"), (0xE00, "Thai"), (0xE80, "Lao"), (0xF00, "letter"), (0x1000, "Burmese"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "letter"), (0x1780, "Khmer"), (0x1800, "letter"), (0x1F00, "Greek"),
    (0x2000, "letter"), (0x3040, "Kana"), (0x3100, "letter"), (0x3130, "Hangul"), (0x3190, "letter"), (0x3400, "Han"), (0xA000, "letter"),
    (0xAC00, "Hangul"), (0xD7B0, "letter"), (0xF900, "Han"), (0xFB00, "letter"), (0x20000, "Han"), (0x32000, "letter"),
)
_LATIN = ("lower", "upper", "accented lower", "accented upper", "digit", "space", "sentence mark", "symbol", "other")
CLASSES = (*_LATIN, *dict.fromkeys(name for _, name in SCRIPTS), "mark", "punctuation")
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
#: Characters with a class of their own; above them all are letters of their block.
_TOP = 0x10000

MIN_WORDS = 50
REPEAT_PERCENT = 50
MIN_CHARS_COMPARED = 200
MIN_WORDS_COMPARED = 100
MAX_CLASS_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.36
WORD_SPREAD = 2.5
#: Common words of a language, and the least share of its documents that hold one.
WORDS_EACH, WORD_SHARE = 150, 0.01
#: Distinct words that a task counts before it passes its counts on; steps of the spread of distances.
HELD, STEPS = 200_000, 1000
_MARKS = b".,;:!?'\"()"


def _class(cp: int) -> int:
    c = chr(cp)
    kind = unicodedata.category(c)
    if c in _SPACES:
        return 5
    if cp < 0x250 and kind in ("Ll", "Lu"):
        return (0 if kind == "Ll" else 1) + 2 * (cp > 127)
    if kind == "Nd":
        return 4
    if cp < 0x250:
        return 6 if c in ".,;:!?'\"-()" else 7 if cp < 128 else 8
    if kind[0] in "LM" and kind != "Mn":
        return CLASSES.index(next(name for first, name in reversed(SCRIPTS) if first <= cp))
    return CLASSES.index("mark" if kind == "Mn" else "punctuation") if kind == "Mn" or kind[0] == "P" else 8


_class_of: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """The class of each code point below _TOP, made when first needed."""
    if not _class_of:
        _class_of.append(np.array([_class(c) for c in range(_TOP)]))
    return _class_of[0]


def class_counts(codes: np.ndarray) -> np.ndarray:
    """How many characters of each class there are."""
    high = codes[codes >= _TOP]
    low = np.bincount(class_table()[codes[codes < _TOP]], minlength=len(CLASSES)).astype(np.int64)
    if len(high):
        block = np.searchsorted([first for first, _ in SCRIPTS], high, side="right") - 1
        names = np.array([CLASSES.index(name) for _, name in SCRIPTS])
        low += np.bincount(np.where(high < 0x20000, 8, names[block]), minlength=len(CLASSES))
    return low


def plain(word: bytes) -> bytes:
    """A word as it is counted: without marks around it, A-Z lower-cased."""
    return word.lower().strip(_MARKS)


def counts(text: str, roll: Rolling, common: dict[bytes, int]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes and common words (as shares) of a text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    classes = class_counts(codes)
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    repeated = np.zeros(len(words), bool)
    if len(words) >= 3:
        key = triples(ids, len(number))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        for i in range(3):
            repeated[i : i + len(key)] |= again
    per_word = np.bincount(ids.astype(np.int64), minlength=len(number))
    where = np.fromiter((common.get(plain(w), WORDS_EACH) for w in number), np.int64, len(number))
    found = np.bincount(where, per_word, WORDS_EACH + 1).astype(np.int64)
    share = lambda x: (x / max(1, x.sum())).tolist()
    symbols = int(np.isin(codes, [ord(c) for c in _SYMBOLS]).sum())
    return len(words), int(len(codes) - classes[5]), symbols, len(lines) - len(set(lines)), int(repeated.sum()), share(classes), share(found)


def triples(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each window of three ids below n, equal for equal windows alone."""
    pairs = ids[:-1] * np.uint64(n) + ids[1:]
    if n >= 2_000_000:  # n**3 doesn't fit: pairs are numbered first
        pairs, n = np.unique(pairs, return_inverse=True)[1].astype(np.uint64), n
    return pairs[:-1] * np.uint64(n) + ids[2:]


def common_words(docs: DataFrame, id_lang: str = "lang") -> dict[str | None, dict[bytes, int]]:
    """language -> word -> place: the words that most documents of the language hold; WORDS_EACH of each language at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                held[lang].update({plain(w) for w in set((text.as_py() or "").encode().split())} | {b""})  # b"" counts documents
                if sum(map(len, held.values())) > HELD:
                    yield flush()
        if held:
            yield flush()
        release()

    n = docs.select(F.col(id_lang).cast("string").alias("lang"), "text").mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    n = materialize(n, "words")
    size = F.broadcast(n.where(F.length("word") == 0).select(F.col("lang").alias("s_lang"), F.col("n").alias("all")))  # a row for each language
    n = n.where(F.length("word") > 0).join(size, F.col("lang").eqNullSafe(F.col("s_lang"))).where(F.col("n") >= WORD_SHARE * F.col("all")).drop("s_lang")
    top = n.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")) - 1).where(F.col("place") < WORDS_EACH)
    out: dict[str | None, dict[bytes, int]] = defaultdict(dict)
    for r in top.select("lang", "word", "place").collect():  # WORDS_EACH rows a language
        out[r.lang][bytes(r.word)] = r.place
    return dict(out)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x)), F.lit(0.0), lambda a, x: a + x) / 2))


def judge(docs: DataFrame, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE, word_spread: float = WORD_SPREAD) -> DataFrame:
    """doc_id, the counts, base_failed, class_distance and word_distance (null if not compared), word_limit and kept."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    longs = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, common = Rolling(3), shared.value
        types = [*[pa.int64()] * 5, *[pa.list_(pa.float64())] * 2]
        names = [x.split()[0] for x in longs.split(", ")]
        for batch in batches:
            rows = [counts(x.as_py() or "", roll, common.get(lang, {})) for x, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *columns], names=["doc_id", "lang", *names, "classes", "common"])
        release()

    found = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, f"doc_id {id_type}, lang string, {longs}, classes array<double>, common array<double>")
    found = found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    found = materialize(found, "quality")
    # A language's means, bin by bin, by partial sums.
    bins = found.where("NOT base_failed").select("lang", F.posexplode(F.concat("classes", "common")).alias("bin", "share"))
    means = bins.groupBy("lang", "bin").agg(F.avg("share").alias("share"))
    reference = means.groupBy(F.col("lang").alias("r_lang")).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "share"))), lambda x: x["share"]).alias("ref"))
    reference = F.broadcast(materialize(reference, "reference", rows=0))  # a row of fixed length for each language
    met = found.join(reference, F.col("lang").eqNullSafe(F.col("r_lang")), "left")
    n = len(CLASSES)
    chars = F.col("word_chars") >= MIN_CHARS_COMPARED
    words = F.col("n_words") >= MIN_WORDS_COMPARED
    met = met.withColumns({
        "class_distance": F.when(chars, distance(F.col("classes"), F.slice("ref", 1, n))),
        "word_distance": F.when(words, distance(F.col("common"), F.slice("ref", n + 1, WORDS_EACH + 1))),
    })
    met = materialize(met.drop("classes", "common", "ref", "r_lang"), "distances")
    # Quartiles of a language's distances from counts of STEPS steps, whatever the number of documents.
    steps = met.where("NOT base_failed AND word_distance IS NOT NULL").groupBy("lang", F.floor(F.col("word_distance") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang")
    upto = steps.withColumns({"upto": F.sum("n").over(w.orderBy("step")), "all": F.sum("n").over(w)})
    quarter = lambda part: (F.min(F.when(F.col("upto") >= part * F.col("all"), F.col("step"))) + 0.5) / STEPS
    limits = upto.groupBy(F.col("lang").alias("l_lang")).agg(quarter(0.25).alias("low"), quarter(0.5).alias("mid"))
    limits = limits.select("l_lang", F.greatest(F.lit(max_word_distance), F.col("mid") + word_spread * (F.col("mid") - F.col("low"))).alias("word_limit"))
    met = met.join(F.broadcast(materialize(limits, "limits", rows=0)), F.col("lang").eqNullSafe(F.col("l_lang")), "left")
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= F.coalesce("word_limit", F.lit(1.0)))
    return met.select("doc_id", *[x.split()[0] for x in longs.split(", ")], "base_failed", "class_distance", "word_distance", "word_limit", (~F.col("base_failed") & near).alias("kept"))
