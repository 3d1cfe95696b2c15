from collections import defaultdict

import pytest
from oracle import SF, assert_same
from pyspark.sql import functions as F

from rowloom.llm import exact_dedup as X
from rowloom.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, key string, salt string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", "s", "x") for i, t, s in rows], DOCS)


@pytest.mark.parametrize("query, sql", [(X.op3_exact_dedup, X.ORACLE), (M.op8_mix_sources, M.ORACLE)])
def test_sql(spark, query, sql):
    assert_same(query(spark, SF), sql)


@pytest.mark.parametrize("query", [X.op3_exact_dedup, M.op8_mix_sources])
def test_no_python(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("digest", [X.sha256_key, lambda t: F.crc32(t) % 2, lambda t: F.lit(1)])
def test_dedup_cases(spark, digest):
    rows = [(1, "a", "s"), (2, "a", None), (3, None, "s"), (4, "", "s"), (5, "A", "s"), (6, "b" * 300_000, "s"), (7, "b" * 300_000, "s"), (None, "n", "s"), (None, "n", "s"), (9, "z", "s"), (9, "z", "s")]
    got = X.exact_groups(docs(spark, rows), digest=digest).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].keep_id, by[i].group_size, by[i].kept) for i in (1, 2, 3, 4, 5, 6, 9)] == [(2, 2, False), (2, 2, True), (4, 2, False), (4, 2, True), (5, 1, True), (7, 2, False), (9, 2, True)]
    assert by[None].keep_id is None and by[None].group_size == 2
    assert X.exact_groups(docs(spark, rows).limit(0), digest=digest).count() == 0
    assert sorted(r.doc_id for r in X.drop_exact_copies(docs(spark, rows[:7])).collect()) == [2, 4, 5, 7]


def test_hot_group_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    got = X.exact_groups(df, salts=4)
    assert got.filter("text_sha256 = sha2('hot', 256)").agg(F.count("*"), F.min("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).collect()[0][:] == (1000, 2997, 1000, 1)


def test_mix_cases(spark):
    rows = [(i, "w " * (i % 7), None if i % 11 == 0 else f"s{i % 4}") for i in range(200)] + [(None, "x y", "s0"), (300, None, "s1"), (301, "", "empty"), (5, "a b", "s1"), (5, "a b", "s1")]
    got = M.mix_amounts(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    total = sum(r.size for r in got)
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted((s for s in by if s is not None)) + [None])}
    targets, left, open_ = {}, 1.5 * total, dict(weights)
    while True:  # shares by weight until none is above its cap
        shares = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if shares[s] > 2 * by[s][0].source_size]
        if not over:
            break
        for s in over:
            targets[s] = 2 * by[s][0].source_size
            left -= targets[s]
            del open_[s]
    for s, rs in by.items():
        want = targets.get(s, shares.get(s))
        assert abs(rs[0].target - want) < 1e-6 and sum(r.taken for r in rs) == int(rs[0].target + 1e-9) and rs[0].source_size == sum(r.size for r in rs)
    assert sorted(map(repr, got)) == sorted(map(repr, M.mix_amounts(docs(spark, rows).repartition(5)).collect()))
    assert M.mix_amounts(docs(spark, rows[:0] + rows).limit(0)).count() == 0


def test_mix_rows(spark):
    rows = [(i, " lead\n" + "w\t" * (i % 9) + "é ", f"s{i % 3}") for i in range(60)]
    df = docs(spark, rows)
    amounts = {r.doc_id: r.taken for r in M.mix_amounts(df).collect()}
    got = defaultdict(int)
    for r in M.mixed(df).collect():
        got[r.doc_id] += len(r.text.split())
    assert dict(got) == {k: v for k, v in amounts.items() if v} and M.mixed(df).columns == df.columns
    one = spark.createDataFrame([("  a b\n c ", 2), ("a", 1), ("a b", 5)], "t string, n int")
    assert [r[0] for r in one.select(M.first_words(F.col("t"), F.col("n"))).collect()] == ["a b", "a", "a b"]
