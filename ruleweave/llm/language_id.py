"""Language identification by a bidirectional gated recurrent network over bytes, written in numpy.

Two recurrent passes read the bytes of a text in strips; both states label every position, and a document's language
is the mean of the probabilities at its letters. Training is backpropagation through time with Adam on strips of a
sample of labelled documents bounded for each language (at most train_docs texts, WINDOWS strips of a text, train_strips
strips; a long text's strips begin at hashed places of the whole text); every label that is not null is learned, and steps
grow with the labels. Prediction reads whole texts. The gates and the state use x / (1 + |x|), whose slope is 1 / (1 + |x|)**2.

Cases: a null text or one without a letter is `und` with score 0; null and repeated doc_ids are rows like any other;
with no labelled document every text is `und`; a single language is predicted with certainty; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

HIDDEN = 8
STRIP = 256
TRAIN_DOCS = 400
#: Strips of one text and of one language at most.
WINDOWS = 4
TRAIN_STRIPS = 1024
#: Steps of training for each STEP_LANGUAGES languages.
STEPS, STEP_LANGUAGES = 300, 4
_BATCH = 64
_letter = regex.compile(r"\p{L}").search
#: Bytes that letters consist of: a-z, A-Z and all of a multi-byte character.
IS_LETTER = np.array([bytes([b]).isalpha() or b >= 128 for b in range(256)])


def _slope(x: np.ndarray) -> np.ndarray:
    """Of x / (1 + |x|)."""
    return 1 / (1 + np.abs(x)) ** 2


class Network:
    """Embedding-free GRU pair: each byte has its own gate inputs; hidden states meet in one linear layer of labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = rng.normal(0, 0.3, (hidden, 2 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = rng.normal(0, 0.3, (hidden, hidden)).astype(np.float32)
        self.p["w"] = rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32)
        self.p["o"] = np.zeros(len(labels), np.float32)

    def _pass(self, d: str, strips: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States at every position, time first. strips: time x strip, 256 stands for nothing."""
        h, (t, n) = self.h, strips.shape
        # Parts of their own: arithmetic on whole arrays is several times faster than on slices of columns.
        xr, xz, xm = (np.ascontiguousarray(self.p[f"x{d}"][:, k * h : k * h + h]) for k in range(3))
        ur, uz, c = *(np.ascontiguousarray(self.p[f"u{d}"][:, k * h : k * h + h]) for k in range(2)), self.p[f"c{d}"]
        state, states = np.zeros((n, h), np.float32), np.empty((t, n, h), np.float32)
        half, one = np.float32(0.5), np.float32(1)

        def gate(u: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = state @ u
            s += x.take(at, 0)
            g = np.abs(s)
            g += one
            np.divide(s, g, out=g)
            g += one
            g *= half
            return s, g

        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            at = strips[i]
            sr, r = gate(ur, xr, at)
            sz, z = gate(uz, xz, at)
            rh = r * state
            m = rh @ c
            m += xm.take(at, 0)
            new = np.abs(m)
            new += one
            np.divide(m, new, out=new)
            if keep is not None:
                keep.append((i, state, sr, sz, r, z, rh, m, new))
            step = new - state
            step *= z
            step += state
            state = step
            states[i] = state
        return states

    def probabilities(self, strips: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Of each label (first axis) at each time and strip."""
        t, n = strips.shape
        f = self._pass("f", strips, None if keep is None else keep.setdefault("f", [])).reshape(-1, self.h)
        b = self._pass("b", strips, None if keep is None else keep.setdefault("b", [])).reshape(-1, self.h)
        y = self.p["w"][: self.h].T @ f.T
        y += self.p["w"][self.h :].T @ b.T
        y += self.p["o"][:, None]
        y -= y.max(0)
        np.exp(y, out=y)
        y /= y.sum(0)
        if keep is not None:
            keep["states"] = np.concatenate((f, b), 1).reshape(t, n, -1)
        return y.reshape(-1, t, n)

    def gradient(self, strips: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the letters' positions, and its slope by backpropagation through time."""
        keep: dict = {}
        y, h = self.probabilities(strips, keep).transpose(1, 2, 0), self.h
        counted = (strips < 256) & np.append(IS_LETTER, False)[strips]
        share = counted / max(1, counted.sum())
        loss = -(np.log(np.maximum(y[:, np.arange(len(target)), target], 1e-9)) * share).sum()
        dy = y.copy()
        dy[:, np.arange(len(target)), target] -= 1
        dy *= share[:, :, None].astype(np.float32)
        grad = {"w": np.einsum("tnh,tnc->hc", keep["states"], dy), "o": dy.sum((0, 1))}
        ds = dy @ self.p["w"].T
        for d, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            u, c = self.p[f"u{d}"], self.p[f"c{d}"]
            gx, gu, gc = (np.zeros_like(self.p[k + d]) for k in "xuc")
            back = np.zeros((strips.shape[1], h), np.float32)
            for i, state, sr, sz, r, z, rh, m, new in reversed(keep[d]):
                dh = part[i] + back
                dm = dh * z * _slope(m)
                drh = dm @ c.T
                dg = np.concatenate((drh * state * _slope(sr), dh * (new - state) * _slope(sz)), 1) * 0.5
                gc += rh.T @ dm
                gu += state.T @ dg
                np.add.at(gx, strips[i], np.concatenate((dg, dm), 1))
                back = dh * (1 - z) + drh * r + dg @ u.T
            grad |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return float(loss), grad

    def fit(self, strips: np.ndarray, target: np.ndarray, steps: int = STEPS, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches. strips: strip x time."""
        rng, losses = np.random.default_rng(seed), []
        mean, var = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            own = rng.integers(0, len(strips), _BATCH)
            loss, grad = self.gradient(strips[own].T, target[own])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                g = g * min(1, 1 / max(norm, 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                var[k] += 0.01 * (g * g - var[k])
                self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def strips_of(data: bytes, size: int = STRIP) -> np.ndarray:
    """A text's bytes in rows of size, the last filled up with 256."""
    a = np.frombuffer(data, np.uint8)
    out = np.full((-(-len(a) // size), size), 256, np.int16)
    out.ravel()[: len(a)] = a
    return out


def windows(seed: int):
    """A short text whole, else WINDOWS pieces of STRIP characters from hashed places."""
    n = F.char_length("text")
    start = lambda i: F.pmod(F.xxhash64(F.lit(seed + 1 + i), "text"), (n - STRIP + 1).cast("long")).cast("int") + 1
    return F.when(n <= WINDOWS * STRIP, F.array("text")).otherwise(F.array(*[F.substring(F.col("text"), start(i), F.lit(STRIP)) for i in range(WINDOWS)]))


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, train_strips: int = TRAIN_STRIPS, steps: int = STEPS, seed: int = 7) -> Network | None:
    """Fit on the first train_docs texts of each language in an order of digests; None if there is no text."""
    rows = labelled.select("text", "lang").where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'").select(windows(seed).alias("texts"), "lang", F.xxhash64(F.lit(seed), "text").alias("o"))
    # The least digests of a language, kept by partial aggregation: no sort of all rows.
    part = rows.groupBy("lang", F.pmod("o", F.lit(train_docs).cast("long")).alias("slot")).agg(F.min(F.struct("o", "texts")).alias("t"))
    got: dict[str, list[np.ndarray]] = {}
    for r in sorted(part.select("lang", "t.texts", "t.o").collect(), key=lambda r: (r.lang, r.o)):
        # A piece of STRIP characters fills one strip at least; a short text all of its strips, WINDOWS at most.
        got.setdefault(r.lang, []).extend(strips_of(x.encode())[: 1 if len(r.texts) > 1 else WINDOWS] for x in r.texts)
    if not got:
        return None
    labels = sorted(got)
    strips = [np.concatenate(got[k])[:train_strips] for k in labels]
    net = Network(labels, seed=seed)
    net.fit(np.concatenate(strips), np.repeat(np.arange(len(labels)), [len(s) for s in strips]), steps * -(-len(labels) // STEP_LANGUAGES))
    return net


def predict(docs: DataFrame, net: Network | None, strip: int = STRIP, rows: int = 2048) -> DataFrame:
    """doc_id, text, lang_pred and score for every row; each whole text is read, strip by strip."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        letter = np.append(IS_LETTER, False)
        for batch in batches:
            data = [x.as_py() for x in batch.column("text")]
            use = [i for i, x in enumerate(data) if net and x and _letter(x)]
            sums = np.zeros((len(data), len(net.labels) if net else 1))
            counts = np.zeros(len(data))
            waiting, held = [], 0

            def settle() -> None:
                nonlocal held
                all_strips = np.concatenate([s for _, s in waiting])
                of = np.repeat([i for i, _ in waiting], [len(s) for _, s in waiting])
                for at in range(0, len(of), rows):
                    part = np.ascontiguousarray(all_strips[at : at + rows].T)
                    weight = letter[part].astype(np.float32)
                    y = net.probabilities(part)
                    np.add.at(sums, of[at : at + rows], np.einsum("ctn,tn->nc", y, weight))
                    np.add.at(counts, of[at : at + rows], weight.sum(0))
                waiting.clear()
                held = 0

            for i in use:
                waiting.append((i, strips_of(data[i].encode(), strip)))
                held += len(waiting[-1][1])
                if held >= rows:
                    settle()
            if waiting:
                settle()
            mean = sums / np.maximum(counts, 1)[:, None]
            best = mean.argmax(1)
            found = set(use)
            lang = [net.labels[best[i]] if i in found else "und" for i in range(len(data))]
            score = [float(min(1.0, mean[i, best[i]])) if i in found else 0.0 for i in range(len(data))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "text", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, f"doc_id {id_type}, text string, lang_pred string, score double")


def held_out(doc_id):
    """The fold that training never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def crc_fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1
