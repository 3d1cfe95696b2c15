from collections import Counter

from oracle import SF

import corpus_pipeline as C
from rowloom.llm import bpe, common
from rowloom.llm.mixing import WORD
from test_near import brute


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in C.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.columns == names
        kept[name] = docs.collect()
    clean = {r.doc_id: r.text for r in kept["toxicity"]}
    assert 850 < len(clean) < 1000
    largest = {t: max(i for i, x in clean.items() if x == t) for t in clean.values()}
    assert {r.doc_id for r in kept["exact_dedup"]} == set(largest.values())
    groups = brute([(i, t) for t, i in largest.items()], 5)
    assert {r.doc_id for r in kept["near_dedup"]} == {i for i, (_, c) in groups.items() if i == c}
    import re

    words = lambda t: len(re.findall(WORD, t))
    size, taken = Counter(), Counter()
    for r in kept["near_dedup"]:
        size[r.source] += words(r.text)
    for r in kept["mix"]:
        taken[r.source] += words(r.text)
        assert r.n_chars == len(r.text)
    assert all(taken[s] <= 2 * size[s] for s in size) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    encoder = bpe.WordBpe(bpe.vocabulary_path())
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r.doc_id, bytes(r.token_ids)) for r in last) == Counter((r.doc_id, encoder.encode([r.text])[0]) for r in kept["mix"])


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, empty and very long texts, and extra columns of the names used within."""
    labels = spark.createDataFrame([(1, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = "one two three four five six seven eight nine ten"
    clash = ["_id", "_size", "_taken", "_time", "_kept_id", "_dropped_id", "_value", "key", "n", "row", "held_out"]
    base = [(1, text, "en", "a", 48), (1, text, "en", "a", 48), (2, text, None, None, None), (3, text + " eleven", "en", "a", 3), (None, None, None, None, None), (None, "alone", None, None, None), (4, "", "en", "b", 0),
            (5, " \n ", "en", "b", 3), (6, "long words " * 30_000, "en", "b", 1), (7, "long words " * 30_000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, *[i] * len(clash)) for i, r in enumerate(base)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` int" for c in clash))
    at = {}
    for name, stage in C.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
        at[name] = Counter((r.doc_id, r.text) for r in docs.collect())
    assert sum(at["toxicity"].values()) == len(base)  # no labels of both kinds: nothing is toxic
    assert at["exact_dedup"] == Counter([(2, text), (3, text + " eleven"), (None, "alone"), (5, " \n "), (4, ""), (7, base[-1][1])]) + Counter({(None, None): at["exact_dedup"][None, None]})
    assert (2, text) in at["near_dedup"] and (3, text + " eleven") not in at["near_dedup"] and (4, "") in at["near_dedup"] and (None, "alone") in at["near_dedup"]
    assert all(t and t.strip() for _, t in at["mix"]) and (7, base[-1][1]) in at["mix"]
    last = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(last) == sum(at["mix"].values())


def test_stages_without_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = common.written(stage(spark, docs, "/root/testdata/sf0.001"), "none")
        assert docs.count() == 0


def test_driver_gives_free_native_memory_back(spark):
    import os
    import re
    from pathlib import Path

    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) >> 10

    df = spark.range(1)
    common.written(df, "one")
    pid = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
    assert pid != os.getpid()
    before = held()
    taken = [spark.sparkContext._jvm.java.util.zip.Deflater() for _ in range(3000)]  # native memory, beside the heap
    most = held()
    assert most - before > 100
    for i, x in enumerate(taken):
        if i % 50:  # what stays lies between
            x.end()
    common.written(df, "one")
    assert most - held() > (most - before) // 2


def test_stages_begin_with_empty_heaps(spark):
    import gc
    import time

    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for stage in (C.exact_dedup, C.mix, C.encode):
        filled = [spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.long, 1 << 27)]  # 1 GB
        most = heap.totalMemory()
        filled.clear()
        gc.collect()
        time.sleep(1)  # for the JVM to hear of it
        stage(spark, docs, SF)
        assert heap.totalMemory() < most - (1 << 29)
