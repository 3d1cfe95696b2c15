import random
from collections import defaultdict

import numpy as np
import pytest
from oracle import SF

from rowloom.llm import near_dedup as N
from rowloom.llm.common import words_of


def brute(rows, width, percent=80):
    """Links between all texts by shingle strings, and components by union-find."""
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets.setdefault(frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else None, []).append(i)
    keys = [k for k in sets if k is not None]
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] is not k:
            k = parent[k]
        return k

    lists = defaultdict(list)
    for k in keys:
        for s in k:
            lists[s].append(k)
    for i, a in enumerate(sorted(keys, key=len)):
        near = {b for s in sorted(a, key=lambda s: len(lists[s]))[: len(a) - -(-len(a) * percent // 100) + 1] for b in lists[s]}  # exact prefix rule
        for b in near:
            if b is not a and 100 * len(a & b) >= percent * len(a | b):
                parent[root(b)] = root(a)
    groups = defaultdict(list)
    for k in keys:
        groups[id(root(k))] += sets[k]
    out = {}
    for k, ids in sets.items():
        for i in ids:
            out[i] = (0 if k is None else len(k), i if k is None else min(groups[id(root(k))]))
    return out


def check(df, rows, width):
    back = N.near_groups(df, width=width).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in back}
    want = brute(rows, width)
    assert len(back) == len(rows) and {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert all(r.kept == (r.doc_id == r.component_id) for r in back)
    return want


@pytest.mark.parametrize("width", [2, 5])
def test_table_against_brute_force(spark, width):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = check(df, [(r.doc_id, r.text) for r in df.collect()], width)
    assert len({c for _, c in want.values()}) < len(want)


def test_chains_hot_pairs_and_groups(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", " \n", "one", "ONE", "one two", "a b " * 400]
    base = [word() for _ in range(120)]
    for _ in range(150):  # a large group of near copies, some too far from each other
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    w = [word() for _ in range(90)]
    for _ in range(40):  # a chain: neighbours alone are near
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    for _ in range(150):  # unrelated texts with one very common passage
        texts.append(" ".join(base[:40] + [word() for _ in range(rng.randrange(10, 60))]))
    for n in range(1, 60):  # small sets at the border of 0.8
        s = [word() for _ in range(n)]
        texts += [" ".join(s), " ".join(s + [word() for _ in range(n // 8)]), " ".join([word(), *s[1:]])]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, node string, sketch string")
    check(df, rows, 2)


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 90, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 62, n // 8)]))
        bits = sum(int(x).bit_count() for x in (N.parity_of(a) ^ N.parity_of(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_groups_about_the_bitmaps_limit(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(50000)}"
    rows = []
    for size in (97, 110, 400, 640, 720, 800, 810, 900, 1000):  # whole sets' bitmaps, both kinds, sketches' alone
        base = [word() for _ in range(size)]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randrange(size // 8)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w[: len(w) - rng.randrange(size // 6)])))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows, 2)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "z z"), (5, "a b c"), (5, "a b c"), (7, "")], "doc_id bigint, text string")
    got = sorted((repr(tuple(r)) for r in N.near_groups(df, width=2).collect()))
    assert got == sorted(map(repr, [(None, 2, 5, False), (None, 2, 5, False), (None, 1, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True)]))
    assert N.near_groups(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "x"), (2, "A b c d e f", "x"), (9, "other words here at all", "x"), (1, None, "x")], "doc_id bigint, text string, digest string")
    kept = N.drop_near_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 9] and kept.columns == df.columns
