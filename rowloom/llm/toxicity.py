"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word (A-Z lower-cased, ASCII punctuation at its ends dropped). Two character models, one of toxic
and one of ordinary documents, give its log-likelihood, each character from up to ORDER - 1 before it, with
word-start and word-end marks. Both use interpolated Kneser-Ney smoothing and share the backoff: below the highest
order that a context reaches in a class, the continuation counts of the two classes together go on, so that an
expression rare in one class is judged by what is common to both. An expression's score is the difference of the two
log-likelihoods divided by its length. A document is as toxic as its most toxic expression: its scores' maximum and
mean go through a logistic curve, fitted on training rows that the models have not seen.

Fitting uses at most SAMPLE rows of each class, those with the smallest hashes of their id, whole texts; that bound
does not grow with the data, so the models are small and each worker gets a copy. Scoring covers all rows.

Cases: null and empty texts have no expression and get the curve's value at zero evidence; without labelled rows of
both classes every score is 0. Null ids are training rows like others; a null label is no label. Repeated rows are
scored alike. No rows give no rows. :func:`score_documents` reads id and text alone and returns new columns only."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import crc_of, table
from rowloom.llm.words import slices, split_words, trimmed

ORDER = 6
#: Labelled rows of each class that the fit may use.
SAMPLE = 2000
#: Of those, one in so many is for the logistic curve.
HELD_FOR_CURVE = 4
#: Expressions whose scores a worker keeps; rows and bytes of a slice.
KEEP, SLICE_ROWS, SLICE_BYTES = 100_000, 1000, 2 << 20
_EDGES = b" \t\n\r\x0b\x0c.,;:!?\"'()[]{}|*#$%&<>-_/\\"


def expressions(text: str | None) -> list[bytes]:
    words = text.encode().lower().split() if text else []
    return [w.strip(_EDGES) or w for w in words]


def _grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, each with an end mark, as windows: keys[n][i] is the hash of the n + 1 bytes that end
    at i, its word's start mark included; valid[n][i] tells whether so many are there. Third: the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b"\x01".join(words) + b"\x01", np.uint8).astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = np.zeros((order, len(raw)), np.uint64)
    valid = np.zeros((order, len(raw)), bool)
    grown = raw + np.uint64(1)
    keys[0], valid[0] = grown, True
    for n in range(1, order):
        before = np.full(len(raw), 2, np.uint64)  # the start mark
        before[n:] = np.where(place[n:] >= n, raw[:-n] + np.uint64(1), np.uint64(2)) if n < len(raw) else before[n:]
        grown = grown + before * np.uint64(257) ** np.uint64(n)
        keys[n], valid[n] = grown, place >= n - 1
    return keys, valid, sizes


class _Table:
    """Sorted keys with counts of a few columns."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[starts]
        self.counts = np.add.reduceat(counts, starts, axis=0) if len(keys) else counts.reshape(0, counts.shape[1])

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros((len(keys), self.counts.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys)[:, None], self.counts[at], 0.0)


class KneserNeyPair:
    """Toxic and ordinary character models with shared backoff."""

    def __init__(self, toxic: Counter, ordinary: Counter, order: int = ORDER) -> None:
        self.order = order
        words = sorted({*toxic, *ordinary})
        keys, valid, sizes = _grams(words, order)
        w = np.array([[toxic[x], ordinary[x]] for x in words], float).reshape(-1, 2)
        weight = np.repeat(w, sizes, axis=0)
        self.base = np.uint64(257)
        self.grams, self.contexts, self.shared, self.shared_contexts = [], [], [], []
        for n in range(order):
            ok = valid[n]
            last = keys[0][ok]
            gram, context = keys[n][ok], (keys[n][ok] - last)
            g = _Table(gram, weight[ok])
            self.grams.append(g)
            c = g.keys - g.keys % self.base
            seen = g.counts > 0
            self.contexts.append(_Table(c, np.hstack([g.counts, seen.astype(float)])))
            # Continuation counts of the classes together: distinct longer grams that end in this one.
            if n + 1 < order:
                up = valid[n + 1]
                longer, pick = np.unique(keys[n + 1][up], return_index=True)
                short = keys[n][up][pick]
            else:
                longer, pick = np.unique(gram, return_index=True)
                short = gram[pick]
            s = _Table(short, np.ones((len(short), 1)))
            self.shared.append(s)
            self.shared_contexts.append(_Table(s.keys - s.keys % self.base, np.hstack([s.counts, np.ones_like(s.counts)])))
        # Absolute discounts from the numbers of grams seen once and twice.
        self.discount = []
        for g in self.grams:
            one, two = float((g.counts == 1).sum()), float((g.counts == 2).sum())
            self.discount.append(one / (one + 2 * two) if one and two else 0.75)

    def difference(self, words: list[bytes]) -> np.ndarray:
        """(log P(word | toxic) - log P(word | ordinary)) / length, for each word."""
        if not words:
            return np.zeros(0)
        keys, valid, sizes = _grams(words, self.order)
        top = valid.sum(axis=0) - 1
        code = keys[top, np.arange(keys.shape[1])] * np.uint64(8) + top.astype(np.uint64)
        codes, first, back = np.unique(code, return_index=True, return_inverse=True)
        p = np.log(self.probabilities(keys[:, first], valid[:, first]))
        per = p[:, 0] - p[:, 1]
        return np.add.reduceat(per[back], np.cumsum(sizes) - sizes) / sizes

    def probabilities(self, keys: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """P of the last byte after those before it, in each class; over all 256 bytes they sum to one."""
        m = keys.shape[1]
        shared = np.full(m, 1 / 256)
        probability = np.full((m, 2), 1 / 256)
        for n in range(self.order):
            context = keys[n] - keys[0]
            d = self.discount[n]
            ok = valid[n]
            both = self.grams[n].get(keys[n])
            total = self.contexts[n].get(context)
            count, n_seen = total[:, :2], total[:, 2:]
            has = ok[:, None] & (count > 0)
            safe = np.maximum(count, 1)
            own = np.maximum(both - d, 0) / safe + d * n_seen / safe * shared[:, None]
            probability = np.where(has, own, np.where(ok[:, None], shared[:, None], probability))
            s = self.shared[n].get(keys[n])[:, 0]
            st = self.shared_contexts[n].get(context)
            use = ok & (st[:, 0] > 0)
            lower = np.maximum(s - 0.75, 0) / np.maximum(st[:, 0], 1) + 0.75 * st[:, 1] / np.maximum(st[:, 0], 1) * shared
            shared = np.where(use, lower, shared)
        return probability


@dataclass
class ToxicModel:
    pair: KneserNeyPair | None
    curve: tuple[float, float, float] = (-50.0, 0.0, 0.0)  # bias, weights of maximum and mean
    keep: int = KEEP

    def __post_init__(self) -> None:
        self.known: dict[bytes, float] = {}

    def features(self, texts: pa.Array) -> np.ndarray:
        """Maximum and mean of each text's expression scores; zeros without expressions."""
        out = np.zeros((len(texts), 2))
        if self.pair is None:
            return out
        words, which, offsets = split_words(texts, lower=True)
        said = [w.strip(_EDGES) or w for w in words]
        new = list({w for w in said if w not in self.known})
        if len(self.known) + len(new) > self.keep:
            self.known, new = {}, list(set(said))
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            self.known.update(zip(some, self.pair.difference(some).tolist(), strict=True))
        each = np.fromiter(map(self.known.__getitem__, said), float, len(said))[which]
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        if len(full):
            starts = offsets[:-1][full]
            out[full, 0] = np.maximum.reduceat(each, starts)
            out[full, 1] = np.add.reduceat(each, starts) / sizes[full]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        bias, a, b = self.curve
        f = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(bias + a * f[:, 0] + b * f[:, 1], -50, 50)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), x / scale])
    w = np.zeros(3)
    keep = ridge * np.diag([1e-3, 1, 1])
    for _ in range(60):  # Newton's method, halving steps that overshoot by the clip
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + keep, z.T @ (y - p) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1] / scale[0]), float(w[2] / scale[1])


def fit(rows: list[tuple[int | None, str | None, int]], order: int = ORDER) -> ToxicModel:
    """rows: id, text, label, in any order."""
    rows = sorted(rows, key=lambda r: (r[2], r[0] is None, r[0] or 0, r[1] or ""))
    counts = (Counter(), Counter())
    curve, turn = [], [0, 0]
    for _, text, label in rows:
        if turn[label] % HELD_FOR_CURVE == HELD_FOR_CURVE - 1:
            curve.append((text, label))
        else:
            counts[1 - label].update(expressions(text))
        turn[label] += 1
    if not (turn[0] and turn[1]):
        return ToxicModel(None)
    model = ToxicModel(KneserNeyPair(*counts, order))
    if len({y for _, y in curve}) < 2:
        curve = [(t, y) for _, t, y in rows]
    model.curve = _logistic(model.features(pa.array([t for t, _ in curve], pa.string())), np.array([y for _, y in curve], float))
    model.known = {}
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` training rows of each class: id, text, label. Chosen by hash among the labels, which are
    small rows, before any text is read."""
    picked = labels.filter(crc_of(F.col("doc_id")) % 5 != 0).filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_label"), F.xxhash64("doc_id").alias("_h"))
    picked = picked.distinct()
    best = [picked.filter(F.col("_label") == y).orderBy("_h").limit(sample) for y in (0, 1)]
    few = F.broadcast(best[0].unionByName(best[1]))  # 2 * sample rows of two numbers at most
    return docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "_label").agg(F.min("text").alias("text")).select("doc_id", "text", "_label")


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """The model of a bounded sample; the fit runs in one task, and the driver gets the finished model."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})
        rows.clear()
        trimmed()

    rows = labelled_sample(docs, labels, sample).repartition(1)
    found = rows.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else ToxicModel(None)


def score_documents(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for some in slices(batches, 2, SLICE_ROWS, SLICE_BYTES):
            s = m.score(some.column(2))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[id_col, "held_out", "score", "predicted"])
        trimmed()

    schema = T.StructType([docs.schema[id_col], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col), (crc_of(F.col(id_col)) % 5 == 0).alias("held_out"), F.col(text_col)).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, columns as they are; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_documents(docs, labels))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, place, SLICE_ROWS, SLICE_BYTES):
            yield some.filter(pa.array(shared.value.score(some.column(place)) < 0.5))
        trimmed()

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_documents(docs, table(spark, sf_dir, "labels")))
