import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF
from tokenizers import Tokenizer

from rowloom.llm import bpe as E
from rowloom.llm import token_files as D
from rowloom.llm import words as words_module
from rowloom.llm.words import slices, split_words

PATH = E.vocabulary_path()
LIBRARY, WORDS, ASKED = Tokenizer.from_file(PATH), E.WordBpe(PATH), D.LibraryEncoder(PATH)
ODD = ["Hello WORLD's don't I'LL we've 123 4½ x² İstanbul ΑΣ ΣΑΣ ß ẞ é ñ Å 北京 日本語。", "<|startoftext|>hi<|endoftext|> <|STARTOFTEXT|> a<|endoftext|>b", "\x1c a\x1fb \x85 x\xa0y z", "", None,
       " \n\t ", "🎉👍🏽 ‍ zwj‍ ", "ｆｕｌｌ ﬁ ǆ ǅ", "'s'S 'T'", "a" * 3000 + " hahahahaha", "é ́x", "﻿bom ­", "word " * 30_000]
DOCS = "doc_id bigint, text string, ids_sha256 string, part string, file string, id string, at string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "p", "f", "d", "a") for i, t in enumerate(texts)], DOCS)


def library(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], t


def test_encoder_equals_library():
    ids, t = library(ODD)
    mine = E.WordBpe(PATH, cache_words=3)
    for _ in range(2):
        got = [np.frombuffer(b"".join(mine.encode([x])), "<u4").tolist() for x in ODD]
        assert got == ids
    assert [mine.decode(np.array(x, "<u4")) for x in ids] == [t.decode(x, skip_special_tokens=False) for x in ids]


def test_library_encoder_equals_library():
    ids, _ = library(ODD)
    mine = D.LibraryEncoder(PATH, keep_words=3, keep_pieces=2)
    for _ in range(2):
        for x, want in zip(ODD, ids, strict=True):
            assert mine.words(pa.array([x], pa.string()))[0].tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(max_codepoint=0x260, exclude_categories=["Cs"]), min_size=1, max_size=12))
def test_pieces_equal_the_library(word):
    """Words of Latin letters, marks, numbers and controls, through both encoders."""
    for w in word.split():
        ids = LIBRARY.encode(w, add_special_tokens=False).ids
        assert np.frombuffer(WORDS.encode([w])[0], "<u4").tolist() == ids and ASKED.words(pa.array([w]))[0].tolist() == ids


def test_words_and_their_places():
    texts = [" a  B c\n", "", None, "a", "  ", "B \x1cx"]
    words, which, offsets = split_words(pa.array(texts), lower=True)
    got = [[words[i] for i in which[x:y]] for x, y in zip(offsets, offsets[1:])]
    assert got == [(t or "").lower().encode().split() for t in texts] and len(set(words)) == len(words)
    assert split_words(pa.array([], pa.string()))[0] == []
    batch = pa.record_batch({"t": ["x" * 10, None, "y" * 50, "", "z"]})
    assert [b.num_rows for b in slices(iter([batch]), 0, 3, 12)] == [2, 1, 2]


def test_index_needs_ascending_merges():
    # "ab" can be made early and late: a pair of it may then outrank the merge that makes it.
    v = {c: i for i, c in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    assert E.PairIndex(v, [("a", "b"), ("ab", "c")]).monotonic
    assert not E.PairIndex(v, [("ab", "c"), ("a", "b")]).monotonic


@pytest.mark.parametrize("source", ["odd", "table"])
def test_queries_equal_library(spark, source):
    df = frame(spark, ODD) if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.select("doc_id", "text").sort("doc_id").collect()
    ids, t = library([r.text for r in rows])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(r.doc_id, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.decode(x, skip_special_tokens=False).encode())) for r, x in zip(rows, ids, strict=True)]
    assert [tuple(r) for r in E.digests(df).sort("doc_id").collect()] == want
    start, stored = 0, []
    for r, x in zip(rows, ids, strict=True):
        stored.append((r.doc_id, start, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())))
        start += len(x) + 1
    assert [tuple(r) for r in D.read_documents(D.token_files(df, file_tokens=5000)).sort("doc_id").collect()] == stored


def test_general_encoder_keeps_columns(spark):
    df = frame(spark, ["a b", None])
    got = E.encode_documents(df).sort("doc_id").collect()
    assert got[0].asDict().keys() == {*df.columns, "token_ids"} and got[1].token_ids == b"" and got[0].part == "p"
    assert E.digests(df.limit(0)).count() == 0 and D.read_documents(D.token_files(df.limit(0))).count() == 0


@pytest.mark.parametrize("top", [10, 255, 256, 49_407, 2**20, 2**31])
def test_random_access(top):
    rng = np.random.default_rng(top)
    docs = [rng.integers(0, top, n).astype("<u4") for n in (0, 1, 511, 512, 513, 3000, 0)]
    every = np.concatenate(docs)
    f = D.DacFile(D.encode_file([5, None, 7, 8, 9, 10, 11], np.array([len(d) for d in docs]), every))
    assert (f.span(0, len(every)) == every).all() and all(f[i] == every[i] for i in rng.integers(0, len(every), 300))
    assert all(f.document(k).tolist() == d.tolist() for k, d in enumerate(docs))
    for a, b in np.sort(rng.integers(0, len(every) + 1, (200, 2)), axis=1):
        assert (f.span(a, b) == every[a:b]).all()
    with pytest.raises(IndexError):
        f[len(every)]
    assert D.DacFile(D.encode_file([], np.zeros(0, int), np.zeros(0, "<u4"))).span(0, 0).size == 0


def test_output_names_that_clash(spark):
    df = spark.createDataFrame([(1, "old", "a b", 7)], "doc_id bigint, token_ids string, text string, _encoded_text int")
    got = E.encode_documents(df.drop("_encoded_text"))
    assert got.columns == ["doc_id", "text", "token_ids"] and len(got.select("token_ids").collect()[0][0]) == 8


def test_repeated_and_null_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "z"), (2, "b"), (2, "a"), (2, "b")], "doc_id bigint, text string")
    files = D.token_files(df)
    got = D.read_documents(files).sort("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 2] and sum(r.n_tokens for r in got) == 8
    D.export_files(files, str(tmp_path))
    assert sum(D.DacFile(p.read_bytes()).n_docs for p in tmp_path.glob("*.dac")) == 4


def test_known_words_take_few_bytes():
    """A worker keeps them from task to task, beside all that later stages need."""
    texts = [pa.array([" ".join(f"w{k}x{i}" for i in range(50_000))]) for k in range(4)]
    words = D.WordIds(lambda new: [b"\1\0\0\0"] * len(new), 10**6)
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for t in texts:
        ids, ends = words(t)
        assert ids.tolist() == [1] * 50_000 and ends.tolist() == [50_000]
    del ids, ends
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 64 * 200_000


@pytest.mark.parametrize("block", [1, 3])
def test_new_words_in_blocks(monkeypatch, block):
    monkeypatch.setattr(words_module, "BLOCK", block)
    ids, _ = library(ODD)
    for mine in (E.WordBpe(PATH), D.LibraryEncoder(PATH)):
        got, ends = mine.words(pa.array(ODD, pa.string()))
        assert [got[x:y].tolist() for x, y in zip([0, *ends], ends)] == ids


def test_known_words_in_use_are_kept_when_others_are_forgotten(monkeypatch):
    asked, looked = [], []

    def encode(new):
        asked.extend(new)
        return [len(w).to_bytes(4, "little") * (len(w) % 3) for w in new]

    known = words_module.KnownIds(encode, 5)
    index_in = words_module.pc.index_in
    monkeypatch.setattr(words_module.pc, "index_in", lambda *a, **k: looked.append(1) or index_in(*a, **k))
    for words in ([b"a", b"bb", b"cccc", b"ddddd"], [b"ddddd", b"x", b"a", b"yyyy"], [b"x", b"bb", b"ddddd"], [], [b"1", b"22", b"333", b"4444", b"55555", b"7777777", b"x"]):
        ids, sizes = known.ids(known.rows(pa.array(words, pa.binary())))
        assert sizes.tolist() == [len(w) % 3 for w in words]
        assert ids.tolist() == [len(w) for w in words for _ in range(len(w) % 3)]
    assert asked == [b"a", b"bb", b"cccc", b"ddddd", b"x", b"yyyy", b"bb", b"1", b"22", b"333", b"4444", b"55555", b"7777777"]
    assert len(looked) == 5


def test_library_encoder_keeps_pieces_in_use():
    encoder = D.LibraryEncoder(PATH, 1, 2)
    asked, ask = [], encoder._asked
    encoder._asked = lambda texts: asked.extend(texts) or ask(texts)
    for words in ([b"one", b"two", b"three"], [b"one", b"four", b"1x1"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.ids_of_words(words)] == [e.ids for e in encoder.library.encode_batch([w.decode() for w in words], add_special_tokens=False)]
    assert b"one" not in b" ".join(asked[1:]).split()


def test_encoding_gives_memory_back_after_each_slice(spark, monkeypatch):
    """What the allocators hold free doesn't add up over the slices of a partition."""
    import random
    import re
    from pathlib import Path

    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = E.encode_documents(df)
    rng = random.Random(5)
    texts = [[" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)) for _ in range(500)] for _ in range(2)]
    free = []

    def batches():
        words_module.trimmed()
        for t in texts:
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(t)), pa.array(t), pa.array(t)], names=["doc_id", "text", "_encoded_text"])
            before = held()
            words_module.trimmed()
            free.append(before - held())

    assert sum(b.num_rows for b in run(batches())) == 1000
    assert max(free) < 16, free
