import math
import tracemalloc
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF

from rowloom.llm import lm_scores as L
from rowloom.llm.common import words_of


def brute(rows):
    train, tokens = Counter(), {}
    for i, t in rows:
        tokens[i] = [*words_of(t), None]
        if crc32(str(i).encode()) % 7 != 2:
            train.update(tokens[i])
    n, v = sum(train.values()), len(train)
    return {i: (crc32(str(i).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


@pytest.mark.parametrize("common", [L.COMMON, 700])
def test_base_and_gain(spark, monkeypatch, common):
    monkeypatch.setattr(L, "COMMON", common)
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got, want = L.op6_lm_scores(spark, SF).collect(), brute([(r.doc_id, r.text) for r in df.collect()])
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and abs(r.base_score - want[r.doc_id][4]) < 1e-6 * r.n_tokens
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_end_is_counted_whatever_its_rank(spark, monkeypatch):
    monkeypatch.setattr(L, "COMMON", 3)
    monkeypatch.setattr(L, "CLASSES", 3)
    rows = [(i, "a b c d e " * 20 + f"w{i}") for i in range(12)]
    want = brute(rows)
    for r in L.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), epochs=1).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and abs(r.base_score - want[r.doc_id][4]) < 1e-6 * r.n_tokens


def test_probabilities_sum_to_one_and_contexts_are_learnt():
    rng = np.random.default_rng(0)
    ids = np.zeros(20_000, np.int64)
    for i in range(1, len(ids)):  # a class follows the one before it nine times in ten
        ids[i] = (ids[i - 1] + 1) % 6 if rng.random() < 0.9 else rng.integers(6)
    unigram = np.full(6, 1 / 6)
    m = L.LogBilinear.fresh(unigram)
    before = L.before_of(ids, np.array([len(ids)]), 6)
    squares = [np.full_like(a, 1e-4) for a in m.arrays()]
    first = m.log_probability(before, ids).mean()
    for _ in range(12):
        m.train(before, ids, unigram, rng, squares)
    assert m.log_probability(before, ids).mean() > first + 0.5
    every = np.exp([m.log_probability(before[:50], np.full(50, k)) for k in range(6)]).sum(axis=0)
    assert np.allclose(every, 1, atol=1e-5)
    c = L.Counts(20, 8, [], np.zeros(0, int), 10, 4, 0.4)
    assert abs((10 ** c.tail_log10(np.array([4.0, 3, 2, 1, 0]))).sum() - 1) < 1e-9


def test_tail_words_have_contexts(spark, monkeypatch):
    """Each tail word is foretold by the one before it; the model grows with the words."""
    monkeypatch.setattr(L, "CLASSES", 4)
    rng = np.random.default_rng(1)
    pairs = [(f"{'abcdefgh'[k]}le{k}", f"{'stuvwxyz'[k]}ri{k}") for k in range(8)]
    texts = [" ".join(w for k in rng.integers(8, size=20) for w in pairs[k]) for _ in range(1500)]
    swapped = [" ".join(w for k in rng.integers(8, size=20) for w in (pairs[k][0], pairs[(k + 1) % 8][1])) for _ in range(20)]
    held = [i for i in range(10**6, 10**6 + 2000) if crc32(str(i).encode()) % 7 == 2]
    right = [(held[i], texts[i], "right") for i in range(20)]
    wrong = [(held[20 + i], t, "wrong") for i, t in enumerate(swapped)]
    df = spark.createDataFrame([(i, t, "train") for i, t in enumerate(texts)] + right + wrong, "doc_id bigint, text string, kind string").coalesce(1)
    got = {r.doc_id: r for r in L.score_documents(df, epochs=30).collect()}
    mean = lambda rows: np.mean([got[i].score / got[i].n_tokens for i, *_ in rows])
    assert mean(right) > mean(wrong) + 0.15


def plain_score(codes, model, tail, own):
    """A text's log10 probability by plain loops over tokens and classes, in double precision."""
    side, total = len(tail.first), 0.0
    soft = lambda q, vectors, bias, k: (z := [float(np.dot(v.astype(float), q)) + float(x) for v, x in zip(vectors, bias)])[k] - np.logaddexp.reduce(z)
    for i, code in enumerate(codes):
        q = np.zeros(L.WIDTH)
        for j in range(L.CONTEXT):
            q += model.contexts[codes[i - 1 - j] if i > j else own + 1].astype(float) * model.position[j]
        total += soft(q, model.targets, model.bias, min(code, own))
        if code > own:
            a, b = divmod(code - own - 2, side)
            total += soft(q, tail.first, tail.first_bias, a) + soft(q, tail.second[a], tail.second_bias[a], b)
    return total / math.log(10)


@pytest.mark.parametrize("size", [1.0, 40.0])
def test_scores_against_plain_loops(size):
    """Also with logits that exp can't take as they are."""
    rng, own, side = np.random.default_rng(3), 9, 3
    draw = lambda *shape: (rng.standard_normal(shape) * size).astype(np.float32)
    model = L.LogBilinear(draw(own + 2 + side * side, L.WIDTH) / 4, draw(L.CONTEXT, L.WIDTH) / size, draw(own + 1, L.WIDTH) / 4, draw(own + 1))
    tail = L.Tail(draw(side, L.WIDTH) / 4, draw(side), draw(side, side, L.WIDTH) / 4, draw(side, side))
    texts = [np.where((c := rng.integers(0, own + side * side, n)) >= own, c + 2, c).astype("<i4") for n in (1, 2, 5, 30)]
    got = L.model_scores(np.concatenate(texts), np.array([len(t) for t in texts]), model, tail, own)
    assert np.allclose(got, [plain_score(t.tolist(), model, tail, own) for t in texts], rtol=1e-4)


def test_scores_do_not_follow_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 50_000)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.collect()
    runs = []
    for n in (1, 6, 16):
        again = spark.createDataFrame(rows[n:] + rows[:n], df.schema).repartition(n)
        runs.append({r.doc_id: (r.score, r.base_score) for r in L.score_documents(again).collect()})
    for other in runs[1:]:
        assert all(np.allclose(other[i], v, rtol=1e-6) for i, v in runs[0].items())


def test_common_words_without_a_cut_among_ties(spark, monkeypatch):
    """More words of one count than the table may hold."""
    monkeypatch.setattr(L, "COMMON", 10)
    rows = [(i, " ".join(f"w{k}" for k in range(40))) for i in range(30)]
    want = brute(rows)
    for r in L.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), epochs=1).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and abs(r.base_score - want[r.doc_id][4]) < 1e-6 * r.n_tokens


def test_groups(spark):
    words = ["a", "ab", "abc", "abcd", "été", "naïveté", "日本語"]
    rows = spark.createDataFrame([(w,) for w in words], "word string").withColumn("g", L.group_column(L.F.col("word"), 5)).collect()
    coder = L.Coder(L.Counts(0, 0, [], np.zeros(0, int), 0, 0, 0.5, 5, np.zeros(25, int), np.zeros(25, int)))
    codes = np.frombuffer(coder(pa.array([" ".join(words)]))[0][0].as_py(), "<i4")
    assert [r.g for r in rows] == (codes[:-1] - 2).tolist()
    tail, q = L.Tail.fresh(np.arange(25), 5), np.random.default_rng(0).standard_normal((9, L.WIDTH)).astype(np.float32)
    assert np.allclose(np.exp([tail.log_probability(q, np.full(9, g)) for g in range(25)]).sum(axis=0), 1, atol=1e-5)
    c = L.Counts(20, 8, [], np.zeros(0, int), 10, 4, 0.4, 2, np.array([7, 3, 0, 0]), np.array([2, 2, 0, 0]))
    assert abs((10 ** c.tail_log10(np.array([4.0, 3, 0]), np.zeros(3, int))).sum() - 1) < 1e-9 and c.tail_log10(np.zeros(1), np.array([3]))[0] == 0


def test_cases(spark):
    df = spark.createDataFrame([(1, "a b a", "x"), (2, None, "x"), (2, "", "x"), (None, "q", "x"), (7, "a " * 5000, "x")], "doc_id bigint, text string, row string")
    got = L.score_documents(df).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 4, 5001] and L.score_documents(df.limit(0)).count() == 0
    only = [i for i in range(60) if crc32(str(i).encode()) % 7 == 2][:2]
    none = L.score_documents(spark.createDataFrame([(i, "a b") for i in only], "doc_id bigint, text string")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.base_score, r.score) for r in none] == [(True, 0, 0, 0.0, 0.0)] * 2


def test_scoring_gathers_vectors_in_blocks():
    """No copies of the vectors of all tokens of a slice: less memory, and it stays in the processor's cache."""
    rng, own, side, n = np.random.default_rng(5), 60, 6, 200_000
    c = rng.integers(0, own + side * side, n)
    codes, sizes = np.where(c >= own, c + 2, c).astype("<i4"), np.full(n // 500, 500)
    model, tail = L.LogBilinear.fresh(np.full(own + 1, 1 / (own + 1)), groups=side * side), L.Tail.fresh(np.ones(side * side, int), side)
    tracemalloc.start()
    got = L.model_scores(codes, sizes, model, tail, own)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * L.WIDTH * n and np.allclose(got[:2], [plain_score(codes[at : at + 500].tolist(), model, tail, own) for at in (0, 500)], rtol=1e-5)
    before = L.before_of(codes, sizes, own + 1)
    first, back = model.distinct(before)
    assert (before[first][back] == before).all() and len({*map(tuple, before[first].tolist())}) == len(first) == back.max() + 1


def test_noise_in_blocks_and_sums_of_runs(monkeypatch):
    rng = np.random.default_rng(0)
    q, vectors, logit = (rng.standard_normal(s).astype(np.float32) for s in ((10, 4), (5, 4), 5))
    monkeypatch.setattr(L, "NOISE_BLOCK", 4)
    pulled, g = L.of_noise(L.with_bias(q), vectors, -L.with_bias(vectors, logit).T)
    down = L.NOISE_WEIGHT / L.NOISE / (1 + np.exp(-(q @ vectors.T + logit)))
    assert np.allclose(pulled, down @ vectors, atol=1e-5)
    assert np.allclose(g[:, :-1], down.T @ q, atol=1e-5) and np.allclose(g[:, -1], down.sum(axis=0), atol=1e-5)
    x, runs = rng.standard_normal((11, 3, 2)), np.array([1, 4, 2, 1, 3])
    assert np.allclose(L.by_runs(x, runs), np.add.reduceat(x, np.cumsum(runs) - runs, axis=0))
    assert L.by_runs(x[:0], runs[:0]).shape == (0, 3, 2)


@pytest.mark.parametrize(("common", "classes"), [(L.COMMON, L.CLASSES), (L.COMMON, 5), (9, 5), (3, 9), (0, 5)])
def test_counts_in_few_passes(spark, monkeypatch, common, classes):
    monkeypatch.setattr(L, "COMMON", common)
    monkeypatch.setattr(L, "CLASSES", classes)
    counts = {L.END: 40} | {f"w{i}": 60 // (i + 1) for i in range(30)}
    df = spark.createDataFrame(list(counts.items()), "word string, c bigint").cache()
    passes, collect, to_arrow = [], type(df).collect, type(df).toArrow
    monkeypatch.setattr(type(df), "collect", lambda d: passes.append(1) or collect(d))
    monkeypatch.setattr(type(df), "toArrow", lambda d: passes.append(1) or to_arrow(d))
    got = L.summary(df)
    assert len(passes) <= (4 if common < classes else 3)
    own = sorted(counts, key=lambda w: (-counts[w], w))[: classes - 1]
    assert sorted(got.words[: classes - 1]) == sorted(own)
    tail = [c for w, c in counts.items() if w not in own]
    assert (got.tokens, got.types, got.tail_tokens, got.tail_types) == (sum(counts.values()), 31, sum(tail), len(tail))
    assert (got.group_tokens.sum(), got.group_types.sum()) == (sum(tail), len(tail))
    assert got.discount == (tail.count(1) / (tail.count(1) + 2 * tail.count(2)) if 1 in tail and 2 in tail else 0.5)
