"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation in numpy.

The model's classes are the most frequent words, the end of a text, and the tail: all other words. The tail is factored
into groups by hashed subwords, side x side of them, where side is the fourth root of the tail's types, so the model grows
with the square root of the vocabulary and a token's cost with the fourth. A tail word's probability is that of the tail,
times that of its ending's group, times that of its beginning's group within, each a softmax in the context, times its
share of the group; as a context it has its group's vector. The groups are trained by the exact gradient of their
softmaxes, which are short.

A context is the CONTEXT classes or groups before a token; its predicted vector is the sum of their vectors, each weighted
elementwise by position, and a class's logit is its product with the class's vector plus a bias. Training tells data
from noise drawn from the unigram distribution. Scoring normalises over the whole class vocabulary: a batch's distinct
contexts times all class vectors, as one matrix product.

Texts are split once: a table in the shared folder keeps each text as codes of classes and groups, which training and
scoring read. The training texts are dealt into shards of about SHARD_TOKENS tokens by a hash of id and text, and a
shard's texts are put in an order of their own, so what is learnt doesn't depend on how the input is partitioned. Every
shard is trained over from the current parameters, and the parameters are averaged by tokens, once an epoch.

Words of a group share its probability by absolute discounting of their counts; what the discount frees is
the probability of an unseen word of the group, one type. Without training words a group is its unseen word.

Counts cover all training tokens. The words of the largest counts, COMMON at most, go to the workers (a bounded table);
the other words of a text are joined to the counts by word, none of which is frequent, and summed by row.

Cases: a null or empty text is its end alone. Without training rows the model knows one unseen type of probability
1, so scores are 0. Null ids hash as the empty text. Repeated rows are scored each. No rows give no rows. Other
columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import crc_of, deleted, freed, table, written
from rowloom.llm.words import slices, split_words, trimmed

CLASSES, WIDTH, CONTEXT = 512, 16, 2
#: Words whose counts every worker has.
COMMON = 200_000
EPOCHS, BATCH, NOISE, NOISE_WEIGHT, RATE = 2, 4096, 64, 16.0, 0.08
#: Tokens of a training shard, on average, and of the stretches that are trained over in random order.
SHARD_TOKENS, STRETCH = 1 << 22, 1 << 18
#: Rows of a slice, whose distinct contexts are scored together.
SLICE_ROWS = 4000
#: Tokens whose vectors are gathered at once in scoring, as many as the processor's cache holds.
SCORE_BLOCK = 4096
#: Tokens whose products with the noise are made at once, for the same reason.
NOISE_BLOCK = 512
#: Bytes of a tail word's beginning and ending that its group depends on; tail tokens a step.
SUBWORD, TAIL_BATCH = 3, 8192
#: Rows of a block of tail tokens with one ending.
TAIL_BLOCK = 64
#: The end of a text among the counted words, which have no space.
END = " "


@dataclass
class Counts:
    """Totals of the training tokens, the common words and the tail's discount."""

    tokens: int
    types: int
    words: list[str]  # most frequent first
    counts: np.ndarray
    tail_tokens: int
    tail_types: int
    discount: float
    side: int = 1
    group_tokens: np.ndarray | None = None
    group_types: np.ndarray | None = None

    #: Classes of words of their own; one more is for the others.
    classes: int = -1

    def __post_init__(self) -> None:
        if self.classes < 0:
            self.classes = min(CLASSES - 1, len(self.words))

    def tail_log10(self, c: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """log10 of a tail word's share in its group, or in all of the tail, by its count; 0 is the unseen type."""
        tokens = np.full(len(c), self.tail_tokens) if group is None else self.group_tokens[group]
        types = self.tail_types if group is None else self.group_types[group]
        of = np.maximum(tokens, 1)
        seen = np.maximum(c - self.discount, 1e-12) / of
        return np.where(tokens > 0, np.log10(np.where(c > 0, seen, np.maximum(self.discount * types, 1e-12) / of)), 0.0)


class Subwords(dict):
    """A subword's bytes to its place on one side of the groups, times a step."""

    def __init__(self, side: int, step: int) -> None:
        self.side, self.step = side, step

    def __missing__(self, part: bytes) -> int:
        self[part] = at = crc32(part) % self.side * self.step
        return at


def group_column(word: Column, side: int) -> Column:
    """The group of :class:`Subwords`, endings first, as a column."""
    raw = word.cast("binary")
    return F.crc32(F.substring(raw, -SUBWORD, SUBWORD)) % side * side + F.crc32(F.substring(raw, 1, SUBWORD)) % side


@dataclass
class LogBilinear:
    """contexts: class, before a text's start, then group of the tail to vector; position: weights; targets, bias: classes."""

    contexts: np.ndarray
    position: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(unigram: np.ndarray, seed: int = 7, groups: int = 0) -> LogBilinear:
        rng, n = np.random.default_rng(seed), len(unigram)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return LogBilinear(draw(n + 1 + groups, WIDTH), np.ones((CONTEXT, WIDTH), np.float32), draw(n, WIDTH), np.log(unigram).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.contexts, self.position, self.targets, self.bias]

    def predicted(self, before: np.ndarray) -> np.ndarray:
        q = np.empty((len(before), self.contexts.shape[1]), np.float32)
        for at in range(0, len(q), SCORE_BLOCK):
            q[at : at + SCORE_BLOCK] = self.parts(before[at : at + SCORE_BLOCK].T)[1]
        return q

    def log_probability(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Natural log of P(after | before), normalised over all classes."""
        first, back = self.distinct(before)
        q = self.predicted(before[first])
        return self.of_distinct(q, back, after)

    def distinct(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A token of each distinct context, and the place of each token's context among these."""
        order = by_value(before[:, -1], len(self.contexts))
        for j in reversed(range(CONTEXT - 1)):
            order = order[by_value(before[:, j].take(order), len(self.contexts))]
        new = np.ones(len(order), bool)
        new[1:] = False
        for j in range(CONTEXT):
            column = before[:, j].take(order)
            new[1:] |= column[1:] != column[:-1]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        return order[new], back

    def of_distinct(self, q: np.ndarray, back: np.ndarray, after: np.ndarray) -> np.ndarray:
        total = log_totals(q, self.targets, self.bias)
        out = np.empty(len(after))
        for at in range(0, len(after), SCORE_BLOCK):
            some, w = back[at : at + SCORE_BLOCK], after[at : at + SCORE_BLOCK]
            out[at : at + SCORE_BLOCK] = np.einsum("ij,ij->i", q.take(some, axis=0), self.targets.take(w, axis=0)).astype(np.float64) + self.bias.take(w) - total.take(some)
        return out

    def train(self, before: np.ndarray, after: np.ndarray, unigram: np.ndarray, rng: np.random.Generator, squares: list[np.ndarray]) -> None:
        """One pass of noise-contrastive estimation over the tokens, in random order, with Adagrad steps."""
        noise_logit = np.log(unigram * NOISE_WEIGHT).astype(np.float32)
        cumulative = np.cumsum(unigram)
        order = rng.permutation(len(after))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            h, w = before.take(some, axis=0).T.astype(np.int64), after.take(some)
            noise = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(unigram) - 1)
            parts, q = self.parts(h)
            tw, tn = self.targets.take(w, axis=0), self.targets.take(noise, axis=0)
            data = np.einsum("ij,ij->i", q, tw) + self.bias[w] - noise_logit[w]
            with np.errstate(over="ignore"):  # the sigmoid of a very small logit is 0
                up = 1 / (1 + np.exp(data))  # 1 - sigmoid
                pulled, g_noise = of_noise(with_bias(q), tn, -with_bias(tn, self.bias[noise] - noise_logit[noise]).T)
            dq = up[:, None] * tw
            dq -= pulled
            scale = np.float32(1 / len(some))
            g_targets = summed(w, up[:, None] * q, len(self.targets))
            np.subtract.at(g_targets, noise, g_noise[:, :-1])
            g_bias = np.bincount(w, up, len(self.bias)).astype(np.float32)
            np.subtract.at(g_bias, noise, g_noise[:, -1])
            g_position = np.stack([np.einsum("ij,ij->j", dq, p) for p in parts])
            for a, g, s in zip(self.arrays()[1:], (g_position, g_targets, g_bias), squares[1:], strict=True):
                adagrad(a, g, s, scale)
            self.step_contexts(h, dq, scale, squares[0])

    def parts(self, h: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The vectors of the contexts (CONTEXT x tokens), and what they predict."""
        parts = [self.contexts.take(x, axis=0) for x in h]
        q = parts[0] * self.position[0]
        for p, weight in zip(parts[1:], self.position[1:], strict=True):
            q += p * weight
        return parts, q

    def step_contexts(self, h: np.ndarray, dq: np.ndarray, scale: np.float32, squares: np.ndarray) -> None:
        """An Adagrad step on the vectors of the contexts. ``scale`` is negative for a descent."""
        adagrad(self.contexts, summed(h.ravel(), np.concatenate([dq * w for w in self.position]), len(self.contexts)), squares, scale)


def of_noise(q: np.ndarray, vectors: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The noise words' pull on each row of q, whose last element is 1, and the rows' on each noise word, its bias last.
    ``wide``: the words' vectors and logits, negated. In blocks of rows that the processor's cache holds."""
    pulled, g = np.empty((len(q), vectors.shape[1]), np.float32), np.zeros((wide.shape[1], q.shape[1]), np.float32)
    held = np.empty((NOISE_BLOCK, wide.shape[1]), np.float32)
    for at in range(0, len(q), NOISE_BLOCK):
        x = q[at : at + NOISE_BLOCK]
        down = np.matmul(x, wide, out=held[: len(x)])
        np.exp(down, out=down)
        down += 1
        np.divide(np.float32(NOISE_WEIGHT / NOISE), down, out=down)
        np.matmul(down, vectors, out=pulled[at : at + NOISE_BLOCK])
        g += (x.T @ down).T
    return pulled, g


def by_runs(x: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The sums of the first ``runs[0]`` of x, the next ``runs[1]``, and so on, one at least each. For few long items, where
    reduceat takes several times as long."""
    first = np.cumsum(runs) - runs
    out = x.take(first, axis=0)
    for j in range(1, int(runs.max(initial=1))):
        more = np.flatnonzero(runs > j)
        out[more] += x.take(first[more] + j, axis=0)
    return out


def by_value(x: np.ndarray, n: int) -> np.ndarray:
    """The stable order of x, whose values are below n: by digits, where two bytes hold them."""
    return np.argsort(x.astype(np.min_scalar_type(n)), kind="stable")


def summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each index below n."""
    return np.stack([np.bincount(index, column, n) for column in np.ascontiguousarray(rows.T)], axis=1).astype(np.float32)


def adagrad(a: np.ndarray, g: np.ndarray, squares: np.ndarray, scale: np.float32) -> None:
    """A step up the gradient ``scale * g``, which is spoilt."""
    g *= scale
    squares += g * g
    root = np.sqrt(squares)
    root += np.float32(1e-3)
    g /= root
    g *= np.float32(RATE)
    a += g


def with_bias(vectors: np.ndarray, bias: np.ndarray | float = 1.0) -> np.ndarray:
    """The vectors with one more element: products of such add the bias by themselves."""
    out = np.empty((len(vectors), vectors.shape[1] + 1), np.float32)
    out[:, :-1], out[:, -1] = vectors, bias
    return out


def bounded(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exp of no product with q can overflow, nor a sum of these vanish."""
    longest = lambda x: float(np.sqrt(np.einsum("...j,...j->...", x, x).max()))
    return not q.size or longest(q) * longest(vectors) + float(np.abs(bias).max()) < 60


def log_totals(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Natural log of the sum over all classes of exp(q x vector + bias), by row of q."""
    out = np.empty(len(q))
    if not len(q):
        return out
    wide = np.ascontiguousarray(with_bias(vectors, bias).T)
    ones, safe = np.ones(len(bias), np.float32), bounded(q, vectors, bias)
    for at in range(0, len(q), 512):  # as much as the processor's cache holds
        z = with_bias(q[at : at + 512]) @ wide
        if safe:
            out[at : at + 512] = np.log(np.exp(z, out=z) @ ones)
        else:
            out[at : at + 512] = log_total(z)
    return out


def log_total(z: np.ndarray) -> np.ndarray:
    """Natural log of the sum of exp by row; overwrites z with exp(z - top)."""
    top = z.max(axis=1, keepdims=True)
    np.exp(np.subtract(z, top, out=z), out=z)
    return top[:, 0] + np.log(z.sum(axis=1).astype(np.float64))


@dataclass
class Tail:
    """Vectors and biases of the groups: of the endings, and of the beginnings within each."""

    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    @staticmethod
    def fresh(tokens: np.ndarray, side: int, seed: int = 8) -> Tail:
        rng, each = np.random.default_rng(seed), tokens.reshape(side, side) + 0.5
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        total = each.sum(axis=1)
        return Tail(draw(side, WIDTH), np.log(total / total.sum()).astype(np.float32), draw(side, side, WIDTH), np.log(each / total[:, None]).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.first, self.first_bias, self.second, self.second_bias]

    def log_probability(self, q: np.ndarray, group: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """Natural log of P(group | tail, context) by predicted vectors: one for each token, or that of ``back``."""
        side = len(self.first)
        a, b = group // side, group % side
        total = log_totals(q, self.first, self.first_bias)
        back = np.arange(len(q)) if back is None else back
        out, order, at = np.empty(len(group)), by_value(a, side), 0
        for k, n in enumerate(np.bincount(a, minlength=side).tolist()):
            for end in range(at + n, at, -SCORE_BLOCK):  # tokens of one ending
                rows = order[max(at, end - SCORE_BLOCK) : end]
                some, right = back.take(rows), b.take(rows)
                x = q.take(some, axis=0)
                own = np.einsum("ij,ij->i", x, self.second[k].take(right, axis=0)).astype(np.float64) + self.second_bias[k].take(right)
                out[rows] = np.einsum("ij,j->i", x, self.first[k]).astype(np.float64) + self.first_bias[k] - total.take(some) + own - log_totals(x, self.second[k], self.second_bias[k])
            at += n
        return out

    def train(self, model: LogBilinear, before: np.ndarray, group: np.ndarray, squares: list[np.ndarray], model_squares: list[np.ndarray]) -> None:
        """Adagrad steps over the tail tokens, on the groups and the model's contexts."""
        side = len(self.first)
        for at in range(0, len(group), TAIL_BATCH):
            h, some = before[at : at + TAIL_BATCH].T.astype(np.int64), group[at : at + TAIL_BATCH]
            a, b = some // side, some % side
            parts, q = model.parts(h)
            safe = bounded(q, self.first, self.first_bias) and bounded(q, self.second, self.second_bias)
            p = missed(with_bias(q) @ with_bias(self.first, self.first_bias).T, np.arange(len(a)), a, safe)
            dq, g_first, g_first_bias = p @ self.first, (q.T @ p).T, np.ones(len(p), np.float32) @ p
            # The second softmax: tokens of one ending in blocks of rows, all blocks in one product.
            order = np.argsort(a, kind="stable")
            counts = np.bincount(a, minlength=side)
            blocks = -(-counts // TAIL_BLOCK)
            of_block = np.repeat(np.arange(side), blocks)
            slot = np.arange(len(a)) + np.repeat((np.cumsum(blocks) - blocks) * TAIL_BLOCK - (np.cumsum(counts) - counts), counts)
            mine = np.zeros((len(of_block) * TAIL_BLOCK, q.shape[1] + 1), np.float32)
            mine[slot, :-1], mine[:, -1] = q.take(order, axis=0), 1
            mine = mine.reshape(len(of_block), TAIL_BLOCK, -1)
            vectors = np.concatenate([self.second, self.second_bias[..., None]], axis=2).take(of_block, axis=0)
            p = missed((mine @ vectors.transpose(0, 2, 1)).reshape(-1, side), slot, b.take(order), safe)
            empty = np.ones(len(p), bool)
            empty[slot] = False
            p[empty] = 0
            p = p.reshape(len(of_block), TAIL_BLOCK, side)
            dq[order] += (p @ vectors).reshape(-1, q.shape[1] + 1)[slot, :-1]
            used = np.flatnonzero(blocks)
            g_second, g_second_bias = np.zeros_like(self.second), np.zeros_like(self.second_bias)
            both = by_runs(p.transpose(0, 2, 1) @ mine, blocks[used])
            g_second[used], g_second_bias[used] = both[..., :-1], both[..., -1]
            g_position = np.stack([np.einsum("ij,ij->j", dq, part) for part in parts])
            scale = np.float32(-1 / len(some))
            model.step_contexts(h, dq, scale, model_squares[0])
            for x, g, s in zip([*self.arrays(), model.position], [g_first, g_first_bias, g_second, g_second_bias, g_position], [*squares, model_squares[1]], strict=True):
                adagrad(x, g, s, scale)


def missed(z: np.ndarray, rows: np.ndarray, right: np.ndarray, safe: bool) -> np.ndarray:
    """The softmax of each row, less 1 at the right place of the ``rows``; in z's memory. Unless ``safe``, exp may
    overflow."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    z[rows, right] -= 1
    return z


def before_of(classes: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The CONTEXT classes before each token, nearest first."""
    place = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(classes), CONTEXT), start, np.int32)
    for j in range(CONTEXT):
        ok = place > j
        out[ok, j] = classes[np.flatnonzero(ok) - j - 1]
    return out


def is_training(key):
    return crc_of(key) % 7 != 2


def count_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, c over all training tokens, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for b in slices(batches, 0, 10 * SLICE_ROWS):
            words, which, _ = split_words(b.column(0), lower=True)
            rows += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(np.bincount(which, minlength=len(words)))], names=["word", "c"])
        if rows:
            yield pa.RecordBatch.from_pydict({"word": [END], "c": [rows]})
        trimmed()

    words = df.filter(is_training(F.col(id_col))).select(text_col).mapInArrow(run, "word string, c bigint")
    return written(words.groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


def summary(counts: DataFrame) -> Counts:
    # The words of COMMON or fewer largest counts, by a histogram of counts in steps of an eighth of an octave.
    step = F.floor(F.log2("c") * 8).alias("step")
    steps = counts.groupBy(step).agg(F.min("c").alias("least"), F.count("*").alias("n"), F.sum("c").alias("c")).orderBy(F.desc("step")).collect()  # 8 rows for each bit of a count
    n_types, n_tokens = sum(r.n for r in steps), sum(r.c for r in steps)
    cut, sofar = None, 0
    for r in steps:
        sofar += r.n
        if sofar > COMMON:
            break
        cut = r.least
    top = {}
    if cut is not None:
        common = counts.filter(F.col("c") >= cut).toArrow()  # COMMON rows at most
        top = dict(zip(common.column("word").to_pylist(), common.column("c").to_pylist(), strict=True))
    if len(top) < min(CLASSES - 1, n_types):  # else the words of the classes are among these
        top |= {r.word: r.c for r in counts.orderBy(F.desc("c"), "word").limit(CLASSES - 1).collect()}
    if top and END not in top:
        top[END] = counts.filter(F.col("word") == END).head()["c"]
    words = sorted(top, key=lambda w: (-top[w], w))
    if END in words[CLASSES - 1 :]:  # the end is always a class of its own
        words.insert(0, words.pop(words.index(END)))
    c = np.array([top[w] for w in words], np.int64)
    own = words[: CLASSES - 1]
    tail = counts.filter(~F.col("word").isin(own)) if own else counts
    tail_tokens, tail_types, once, twice = n_tokens - sum(top[w] for w in own), n_types - len(own), 0, 0
    side = max(1, round(tail_types**0.25))
    tokens, types = np.zeros(side * side, np.int64), np.zeros(side * side, np.int64)
    seen = [F.count(F.when(F.col("c") == i, 1)).alias(name) for i, name in ((1, "once"), (2, "twice"))]
    for r in tail.groupBy(group_column(F.col("word"), side).alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("n"), *seen).collect():  # as many as groups
        tokens[r.g], types[r.g] = r.c, r.n
        once, twice = once + r.once, twice + r.twice
    discount = once / (once + 2 * twice) if once and twice else 0.5
    return Counts(n_tokens, n_types, words, c, tail_tokens, tail_types, discount, side, tokens, types)


class Coder:
    """Codes of words, and what counts alone say of them. A code is a class, or classes + 2 and the group of a tail
    word; classes stands for the tail as a class, classes + 1 for what is before a text."""

    def __init__(self, counts: Counts) -> None:
        self.own, side = counts.classes, counts.side
        self.place = {w.encode(): i for i, w in enumerate(counts.words)}
        self.endings, self.beginnings = Subwords(side, side), Subwords(side, 1)
        self.norm = float(np.log10(counts.tokens + counts.types + 1))
        groups = np.array([self.group(w) for w in self.place], np.int64)
        c = counts.counts
        # By place in the table; the last is for what is not there.
        self.code = np.r_[np.where(np.arange(len(c)) < self.own, np.arange(len(c)), self.own + 2 + groups), -1].astype(np.int64)
        self.base = np.r_[np.log10(c + 1.0) - self.norm, 0.0]
        self.share = np.r_[np.zeros(self.own), counts.tail_log10(c[self.own :].astype(float), groups[self.own :]), 0.0]
        self.end = self.place.get(END.encode(), -1)

    def group(self, word: bytes) -> int:
        return self.endings[word[-SUBWORD:]] + self.beginnings[word[:SUBWORD]]

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """For each text: its codes, the end's last, as little-endian 32-bit integers; tokens, known tokens, base and
        share of these; the words that are not in the table."""
        words, which, offsets = split_words(texts, lower=True)
        get, own, n = self.place.get, self.own, len(texts)
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        code = self.code[at]
        absent = np.flatnonzero(at < 0)
        code[absent] = [own + 2 + self.group(words[i]) for i in absent.tolist()]
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)

        def sums(each: np.ndarray, last: float) -> np.ndarray:
            out = np.full(n, last, each.dtype)
            if len(full):
                out[full] += np.add.reduceat(each[which], offsets[:-1][full])
            return out

        codes = np.full(len(which) + n, own if self.end < 0 else self.code[self.end], "<i4")
        codes[np.arange(len(which)) + np.repeat(np.arange(n), sizes)] = code[which]
        raw, cuts = codes.tobytes(), [0, *(4 * (offsets[1:] + np.arange(1, n + 1))).tolist()]
        is_rare = at[which] < 0
        rare = np.cumsum(np.r_[0, is_rare])[offsets]
        of_absent = np.zeros(len(words), np.int64)
        of_absent[absent] = np.arange(len(absent))
        names = pa.array([words[i] for i in absent.tolist()], pa.binary()).cast(pa.string())
        rare_words = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), names.take(pa.array(of_absent[which[is_rare]])))
        return (pa.array([raw[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary()), sizes + 1, sums((at >= 0).astype(np.int64), int(self.end >= 0)), sums(self.base[at], self.base[self.end] if self.end >= 0 else 0.0),
                sums(self.share[at], 0.0), rare_words)


def coded(df: DataFrame, counts: Counts, id_col: str, text_col: str) -> DataFrame:
    """The written table of row (a number), id, key (a hash of id and text), held_out, and what :class:`Coder` says."""
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, row = Coder(shared.value), TaskContext.get().partitionId() << 33
        for b in slices(batches, 3, SLICE_ROWS):
            codes, tokens, known, base, share, rare = coder(b.column(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b.num_rows)), *b.columns[:3], pa.array(tokens), pa.array(known), pa.array(base), pa.array(share), rare, codes],
                                             names=["row", id_col, "key", "held_out", "n_tokens", "known", "base", "share", "rare", "codes"])
            row += b.num_rows
        trimmed()

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.xxhash64(id_col, text_col).alias("key"), (~is_training(F.col(id_col))).alias("held_out"), F.col(text_col))
    return written(rows.mapInArrow(run, f"row long, `{id_col}` {kind}, key long, held_out boolean, n_tokens long, known long, base double, share double, rare array<string>, codes binary"), "coded-texts")


def shards_of(texts: DataFrame, tokens: int) -> DataFrame:
    """The written table of training shards, a row each: shard, sizes of its texts, their codes."""

    def pack(rows: pa.Table) -> pa.Table:
        mine = sorted(zip(rows.column("key").to_pylist(), rows.column("codes").to_pylist(), strict=True))
        sizes = np.array([len(c) // 4 for _, c in mine], "<i8")
        return pa.table({"shard": [rows.column("shard")[0].as_py()], "sizes": pa.array([sizes.tobytes()], pa.binary()), "codes": pa.array([b"".join([c for _, c in mine])], pa.binary())})

    n = max(1, round(tokens / SHARD_TOKENS))
    rows = texts.filter("NOT held_out").select(F.pmod("key", F.lit(n)).alias("shard"), "key", "codes")
    return written(rows.groupBy("shard").applyInArrow(pack, "shard long, sizes binary, codes binary"), "shards")


def train(shards: DataFrame, counts: Counts, epochs: int = EPOCHS) -> tuple[LogBilinear, Tail]:
    own, side, sc = counts.classes, counts.side, shards.sparkSession.sparkContext
    unigram = np.r_[counts.counts[:own], counts.tail_tokens].astype(np.float64) + 0.5
    unigram /= unigram.sum()
    model, tail = LogBilinear.fresh(unigram, groups=side * side), Tail.fresh(counts.group_tokens, side)
    for epoch in range(epochs if counts.tokens else 0):
        shared = sc.broadcast(([*model.arrays(), *tail.arrays()], unigram))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, epoch=epoch) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            start, unigram = shared.value
            flat, seen = 0.0, 0
            for b in batches:
                for at in range(b.num_rows):
                    shard = b.column(0)[at].as_py()
                    sizes, codes = (np.frombuffer(b.column(i)[at].as_buffer(), kind) for i, kind in ((1, "<i8"), (2, "<i4")))
                    arrays = [a.copy() for a in start]
                    mine, groups = LogBilinear(*arrays[:4]), Tail(*arrays[4:])
                    squares = [np.full_like(a, 1e-4) for a in arrays]
                    rng = np.random.default_rng([epoch, shard])
                    before = before_of(codes, sizes, own + 1)
                    for x in range(0, len(codes), STRETCH):
                        ids, h = codes[x : x + STRETCH].astype(np.int64), before[x : x + STRETCH]
                        rare = np.flatnonzero(ids > own)
                        group = ids[rare] - own - 2
                        ids[rare] = own
                        mine.train(h, ids, unigram, rng, squares[:4])
                        order = rng.permutation(len(rare))
                        groups.train(mine, h[rare[order]], group[order], squares[4:], squares[:4])
                    seen += len(codes)
                    flat = flat + np.concatenate([a.ravel().astype(np.float64) for a in arrays]) * len(codes)
            if seen:
                b = codes = sizes = before = None
                trimmed()
                yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId() % 16], "seen": [seen], "weights": pa.array([flat.tobytes()], pa.binary())})

        def merge(key, rows):
            import pandas as pd

            total = sum(np.frombuffer(w, np.float64) for w in rows["weights"])
            return pd.DataFrame({"seen": [int(rows["seen"].sum())], "weights": [total.tobytes()]})

        trained = shards.select("shard", "sizes", "codes").mapInArrow(run, "part long, seen long, weights binary")
        merged = trained.groupBy("part").applyInPandas(merge, "seen long, weights binary").collect()  # 16 rows of the model's size at most
        if merged:
            flat = sum(np.frombuffer(r.weights, np.float64) for r in merged) / sum(r.seen for r in merged)
            shapes = [*model.arrays(), *tail.arrays()]
            new = [x.reshape(a.shape).astype(np.float32) for x, a in zip(np.split(flat, np.cumsum([a.size for a in shapes])[:-1]), shapes, strict=True)]
            model, tail = LogBilinear(*new[:4]), Tail(*new[4:])
    return model, tail


def model_scores(codes: np.ndarray, sizes: np.ndarray, model: LogBilinear, tail: Tail, own: int) -> np.ndarray:
    """log10 of each text's probability but for the shares of tail words in their groups."""
    before = before_of(codes, sizes, own + 1)
    first, back = model.distinct(before)
    q = model.predicted(before[first])
    classes = np.minimum(codes.astype(np.int64), own)
    p = model.of_distinct(q, back, classes)
    in_tail = np.flatnonzero(codes > own)
    of_tail = back.take(in_tail)
    is_used = np.zeros(len(first), bool)
    is_used[of_tail] = True
    place = (np.cumsum(is_used) - 1).take(of_tail)
    p[in_tail] += tail.log_probability(q[is_used], codes[in_tail].astype(np.int64) - own - 2, place)
    return np.add.reduceat(p, np.cumsum(sizes) - sizes) / np.log(10)


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS) -> DataFrame:
    """One row for each row of ``df``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    counted = count_words(df, id_col, text_col)
    freed(df.sparkSession)
    counts = summary(counted)
    texts = coded(df, counts, id_col, text_col)
    shards = shards_of(texts, counts.tokens)
    freed(df.sparkSession)
    model, tail = train(shards, counts, epochs)
    deleted(shards)
    own, side, trained = counts.classes, counts.side, counts.tokens > 0
    shared = df.sparkSession.sparkContext.broadcast((model.arrays(), tail.arrays()))
    norm = float(np.log10(counts.tokens + counts.types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, groups = shared.value
        lbl, rest = LogBilinear(*arrays), Tail(*groups)
        for b in slices(batches, b_codes, SLICE_ROWS):
            sizes = pc.binary_length(b.column(b_codes)).to_numpy().astype(np.int64) // 4
            codes = np.frombuffer(b"".join(b.column(b_codes).to_pylist()), "<i4")
            p = model_scores(codes, sizes, lbl, rest, own) if trained and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:b_codes], pa.array(p)], names=[*b.schema.names[:b_codes], "model"])
        trimmed()

    kept = ["row", id_col, "held_out", "n_tokens", "known", "base", "share"]
    b_codes = len(kept)
    scored = texts.select(*kept, "codes").mapInArrow(run, T.StructType([*[texts.schema[c] for c in kept], T.StructField("model", T.DoubleType())]))
    c = F.coalesce("c", F.lit(0))
    shares = df.sparkSession.createDataFrame([(g, int(n), float(u)) for g, (n, u) in enumerate(zip(counts.group_tokens, counts.tail_log10(np.zeros(side * side), np.arange(side * side)), strict=True))], "g bigint, of bigint, unseen double")
    share = F.when(c > 0, F.log10((c - counts.discount) / F.col("of"))).otherwise(F.col("unseen"))
    found = texts.select("row", F.explode("rare").alias("word")).join(counted, "word", "left").withColumn("g", group_column(F.col("word"), side)).join(F.broadcast(shares), "g", "left")
    sums = found.groupBy("row").agg(F.sum((c > 0).cast("long")).alias("k"), F.sum(F.log10(c + 1.0) - F.lit(norm)).alias("b"), F.sum(share).alias("s"))
    out = scored.join(sums, "row", "left")
    return out.select(F.col(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("bigint").alias("train_tokens"),
                      (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("model") + F.col("share") + F.coalesce("s", F.lit(0.0))).alias("score"))


def op6_lm_scores(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))
