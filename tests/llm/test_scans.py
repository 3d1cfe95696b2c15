import base64
import bz2
import gzip
import hashlib
import lzma
import math
import re
import zlib
from collections import Counter
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF

from rowloom.llm import secrets as S
from rowloom.llm import toxicity as X

SECRET = "password=hunter2hunter2"


def naive(text):
    """The base rules, character by character class, without shortcuts."""
    out = []
    for kind, pattern, group, least in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
                                        ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_on_the_table(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = S.op7_secrets(spark, SF).collect()
    assert len(got) == len(rows) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        want = naive(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [len(re.findall(rf"{k}:", want)) for k in S.KINDS]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("text", ["é🎉 PassWord: 'abcdefgh' " + "a" * 40, "token=short secret = \"long-enough_1\" AKIA" + "A" * 11 + " AKIA" + "9" * 12, "api_key=x api_key:=y1234567 APIKEY==abcdefgh", "ＰＡＳＳＷＯＲＤ=abcdefgh ſecret=abcdefgh toKen=abcdefgh", "0" * 31 + "g" + "f" * 32, ""])
def test_base_cases(text):
    assert S.render(S.base_spans(text)) == naive(text)


def wrap(layer, raw):
    if layer == "url":
        return "".join(f"%{b:02X}" for b in raw)
    if layer == "unicode":
        return "".join(f"\\u{ord(c):04x}" for c in raw.decode())
    packed = {"base64": raw, "gzip": gzip.compress(raw, mtime=0), "zlib": zlib.compress(raw), "bzip2": bz2.compress(raw), "xz": lzma.compress(raw)}[layer]
    return base64.b64encode(packed).decode()


@pytest.mark.parametrize("layers", [("url",), ("unicode",), ("base64",), ("gzip",), ("zlib",), ("bzip2",), ("xz",), ("base64", "url"), ("url", "base64"), ("gzip", "base64", "unicode"), ("base64",) * 4, ("unicode", "gzip", "url", "base64")])
def test_layers(layers):
    inner = SECRET
    for x in layers:
        inner = wrap(x, inner.encode())
    before = "ünï "
    base, every = S.scan_text(f"{before}{inner} tail")
    hit = [s for s in every if s[2].endswith(">assign")]
    assert hit and all(a >= len(before) and b <= len(before) + len(inner) for a, b, _ in hit) and not [s for s in base if s[2] == "assign"]
    if layers[-1] not in ("url", "unicode"):
        assert (len(before), len(before) + len(inner)) in [(a, b) for a, b, _ in hit]


def test_part_encoded_and_cycles():
    text = "x password%3Dabcdefgh1 y %41%4B%49%41" + "B" * 14
    _, every = S.scan_text(text)
    assert (2, 22, "url>assign") in every and (25, len(text), "url>access") in every
    assert S.scan_text("%25" * 50)[1] == [] and S.scan_text(quote("%" * 20) * 3)[1] == []
    bomb = base64.b64encode(zlib.compress(b"a" * (S.WINDOW + 2))).decode()
    assert S.scan_text(bomb)[1] == [(0, len(bomb), "base64>zlib>hex")]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_long_streams_are_scanned_whole(monkeypatch, pack):
    """Secrets at the first byte, over a window's end and at the last byte."""
    monkeypatch.setattr(S, "WINDOW", 1 << 18)
    monkeypatch.setattr(S, "OVERLAP", 1 << 12)
    line, key = b"some words of a long log file\n", b"AKIA" + b"Q" * 16
    for fill in (line, b"a b "):
        raw = bytearray(fill * 60_000)
        raw[: len(SECRET)] = SECRET.encode()
        raw[(1 << 18) - 9 : (1 << 18) - 9 + len(key)] = key
        raw += b" " + b"0123456789abcdef" * 2
        text = "x " + base64.b64encode(pack(bytes(raw))).decode()
        got = {(a, b, k.rpartition(">")[2]) for a, b, k in S.scan_text(text)[1]}
        assert {(2, len(text), k) for k in S.KINDS} <= got


@pytest.mark.parametrize("front", ["", "i", "id", "id-", "/v/", "x/y-z_q"])
def test_base64_glued_to_other_letters(front):
    for tail in ("", "Zz"):
        text = f"at {front}{base64.b64encode(b'user=me ' + SECRET.encode()).decode().rstrip('=')}{tail} end"
        assert (3, len(text) - 4, "base64>assign") in S.scan_text(text)[1]
    assert any(k == "base64>gzip>assign" for _, _, k in S.scan_text("id-" + base64.b64encode(gzip.compress(SECRET.encode())).decode())[1])


def test_deep_percent_signs_and_time():
    from time import process_time

    for levels in (1, 2, 7, 8, 9, 30, 40_000):
        text = "password%" + "25" * levels + "3Dabcdefgh1"
        assert any(a == 0 and b == len(text) and k.endswith("url>assign") for a, b, k in S.scan_text(text)[1]), levels
    began = process_time()
    text = "%41 \\u0042 " * 4000
    for _ in range(3):
        text = quote(text)
    S.scan_text(text)
    assert len(text) > 100_000 and process_time() - began < 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["url", "unicode", "base64", "gzip"]), min_size=1, max_size=5), st.text("ab é%&=\n", max_size=12), st.text("xy \n", max_size=6))
def test_random_nestings(layers, before, after):
    """The span of what is hidden under any layers, told in the original, against where it was put."""
    inner = SECRET
    for x in layers:
        inner = wrap(x, inner.encode())
    text = f"{before} {inner} {after}"
    first, last = len(before) + 1, len(before) + 1 + len(inner)
    hit = [(a, b) for a, b, k in S.scan_text(text)[1] if k.endswith(">assign")]
    assert any(first <= a and b <= last for a, b in hit)
    if layers[-1] in ("base64", "gzip") and not before.strip("é%&=\n "):
        assert (first, last) in hit


def test_parts_against_a_plain_walk():
    """Where characters come from, by sorted offsets and by walking over all parts."""
    layer = S.Layer("ab%41%42cd%2525x", "", [(0, 16, 0, 16, False)])
    while new := S._replaced(layer, "url", S._URL, S._percent):
        for x in range(len(new.text)):
            for y in range(x + 1, len(new.text) + 1):
                touched = [p for p in new.parts if p[0] < y and p[1] > x]
                low = min(p[2] if p[4] else p[2] + max(x, p[0]) - p[0] for p in touched)
                high = max(p[3] if p[4] else p[2] + min(y, p[1]) - p[0] for p in touched)
                assert new.source(x, y) == (low, high, any(p[4] for p in touched))
        layer = new
    assert layer.name == "url>url"


def kinds(text):
    return {k for _, _, k in S.scan_text(text)[1]}


CONFIG = "".join(f"# line {i} of a config file\nuser{i * i}=someone\n" for i in range(9)) + SECRET + "\n"


@pytest.mark.parametrize("wrapped", [lambda x: x, lambda x: x.replace("\n", "\r\n"), lambda x: x.replace("\n", "\n    "), lambda x: x.replace("\n", "\\n"), lambda x: f"word\n{x}\nregards\nme", lambda x: f"key: {x}"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, lambda raw: b"\xff\x80" + raw, lambda raw: raw.decode().encode("utf-16-le"), lambda raw: raw.decode().encode("utf-16-be")])
def test_base64_over_lines(wrapped, pack):
    body = base64.encodebytes(pack(CONFIG.encode())).decode().rstrip("\n")
    assert body.count("\n") > 1 and any(k.endswith(">assign") for k in kinds(wrapped(body)))


def test_base64_short_last_line():
    body = base64.b64encode(b"x" * 40 + b" " + SECRET.encode()).decode()
    text = f"{body[:76]}\n{body[76:]}"
    assert len(body[76:]) < 16 and (0, len(text), "base64>assign") in S.scan_text(text)[1]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_bytes_in_escapes(pack):
    from json import dumps
    from urllib.parse import quote_plus

    raw = pack(CONFIG.encode())
    for text in (quote(raw), quote_plus(raw), wrap("url", raw), repr(raw), dumps(raw.decode("latin-1")), "".join(f"\\x{b:02x}" for b in raw), base64.b64encode(b"head" + raw).decode()):
        assert any(k.endswith(">assign") for k in kinds(f"ü {text} end")), text


def test_compressed_members():
    raw = gzip.compress(b"first member pass") + gzip.compress(SECRET[4:].encode())
    assert "base64>gzip>assign" in kinds(base64.b64encode(raw).decode())
    both = zlib.compress(b"nothing here") + bz2.compress(SECRET.encode())
    assert "base64>bzip2>assign" in kinds(base64.b64encode(both).decode())


def test_scan_frame(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (2, SECRET, None), (None, SECRET, "x")], "doc_id bigint, text string, spans string")
    got = S.scan_documents(df).sort("doc_id").collect()
    assert [r.n_assign for r in got] == [1, 0, 0, 1] and got[0].spans == f"assign:0:{len(SECRET)}" and S.scan_documents(df.limit(0)).count() == 0


def test_pair_is_a_distribution():
    pair = X.KneserNeyPair(Counter({b"idiot": 5, b"the": 20, b"idiom": 1}), Counter({b"the": 90, b"then": 9, b"of": 30}), order=3)
    assert pair.difference([b"idiot"])[0] > 0.5 > abs(pair.difference([b"zzz"])[0])
    assert pair.difference([b"then"])[0] < 0 and pair.difference([]).size == 0


class PlainPair:
    """The two models by dictionaries and recursion, a gram at a time."""

    def __init__(self, toxic, ordinary, order):
        self.order = order
        self.count, self.after, self.before = {}, {}, {}
        for w in {*toxic, *ordinary}:
            said = b"\1" + w + b"\1"  # the start, and the end
            for i in range(1, len(said)):
                for n in range(min(order, i + 1)):
                    gram = said[i - n : i + 1]
                    for k, c in enumerate((toxic[w], ordinary[w])):
                        if c:
                            self.count[k, gram] = self.count.get((k, gram), 0) + c
                            self.after.setdefault((k, n, gram[:-1]), set()).add(gram)
                    longer = said[i - n - 1 : i + 1] if n + 1 < order else None
                    if n + 1 == order:
                        self.before.setdefault((n, gram), set()).add(gram)
                    elif i - n - 1 >= 0:
                        self.before.setdefault((n, gram), set()).add(longer)
        self.discount = []
        for n in range(order):
            c = [v for (_, g), v in self.count.items() if len(g) == n + 1]
            one, two = c.count(1), c.count(2)
            self.discount.append(one / (one + 2 * two) if one and two else 0.75)

    def shared(self, said, i, n):
        if n < 0:
            return 1 / 256
        if i - n < 0:
            return self.shared(said, i, n - 1)
        gram, low = said[i - n : i + 1], self.shared(said, i, n - 1)
        ends = {g: len(x) for (m, g), x in self.before.items() if m == n and g[:-1] == gram[:-1]}
        total = sum(ends.values())
        return max(ends.get(gram, 0) - 0.75, 0) / total + 0.75 * len(ends) / total * low if total else low

    def probability(self, k, said, i):
        p = 1 / 256
        for n in range(min(self.order, i + 1)):
            gram, low, d = said[i - n : i + 1], self.shared(said, i, n - 1), self.discount[n]
            seen = self.after.get((k, n, gram[:-1]), set())
            total = sum(self.count[k, g] for g in seen)
            p = max(self.count.get((k, gram), 0) - d, 0) / total + d * len(seen) / total * low if total else low
        return p

    def difference(self, word):
        said = b"\1" + word + b"\1"
        return sum(math.log(self.probability(0, said, i)) - math.log(self.probability(1, said, i)) for i in range(1, len(said))) / (len(word) + 1)


@pytest.mark.parametrize("order", [1, 2, 3, 6])
def test_pair_against_dictionaries(order):
    toxic, ordinary = Counter({b"idiot": 5, b"the": 20, b"idiom": 1, "é".encode(): 2}), Counter({b"the": 90, b"then": 9, b"of": 30, b"on": 1})
    fast, plain = X.KneserNeyPair(toxic, ordinary, order), PlainPair(toxic, ordinary, order)
    words = [b"idiot", b"the", b"then", b"idle", b"zzz", b"o", b"hen", "é".encode(), b"offthe"]
    assert np.allclose(fast.difference(words), [plain.difference(w) for w in words], atol=1e-9)
    for front in (b"", b"i", b"idi", b"th", b"q", b"idiot"):  # every byte that may follow
        p = []
        for b in range(256):
            keys, valid, _ = X._grams([front] if b == 1 else [front + bytes([b])], order)
            p.append(fast.probabilities(keys[:, len(front) : len(front) + 1], valid[:, len(front) : len(front) + 1])[0])
        assert np.allclose(np.sum(p, axis=0), 1)


def test_features_against_a_plain_walk():
    model = X.fit([(i, t, y) for i, t, y in planted(200)])
    texts = ["Gronk, (the) the!", None, "", " \n ", "!!! ...", "word " * 50_000 + "gronkish", "the the the", "the the the"]
    want = []
    for t in texts:
        d = [float(model.pair.difference([w])[0]) for w in X.expressions(t)[-60:]] if t != texts[5] else [float(model.pair.difference([w])[0]) for w in (b"word", b"gronkish")]
        want.append((max(d), (50_000 * d[0] + d[1]) / 50_001) if t == texts[5] else (max(d), sum(d) / len(d)) if d else (0, 0))
    assert np.allclose(model.features(pa.array(texts)), want)
    model.keep = 1
    assert np.allclose(model.features(pa.array(texts)), want)


def planted(n):
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["the", "an", "ti", "on", "er", "re"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["gronk", "gronkish", "gronker"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy():
    rows = planted(600)
    model = X.fit(rows[:400])
    s = model.score(pa.array([t for _, t, _ in rows[400:]]))
    assert ((s >= 0.5) == [y == 1 for *_, y in rows[400:]]).mean() > 0.97 and 0 <= s.min() <= s.max() <= 1
    one = pa.array(["gronky the"])
    assert (X.fit(rows[:400][::-1]).score(one) == model.score(one)).all()


def test_labels_of_held_out_rows_do_not_count(spark):
    rows = planted(300)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (7, "", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 0)], "doc_id bigint, toxic int")
    from zlib import crc32

    flipped = spark.createDataFrame([(i, y if crc32(str(i).encode()) % 5 else 1 - y) for i, _, y in rows] + [(3, None), (None, 0)], "doc_id bigint, toxic int")
    got = X.score_documents(docs, X.fit_documents(docs, labels)).sort("doc_id", "score").collect()
    assert got == X.score_documents(docs, X.fit_documents(docs, flipped)).sort("doc_id", "score").collect()
    assert len(got) == 302 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None]
    truth = {i: y for i, _, y in rows}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    clean = X.drop_toxic(docs, labels)
    assert clean.columns == docs.columns and 200 < clean.count() < 260
    nothing = X.score_documents(docs, X.fit_documents(docs, labels.limit(0))).collect()
    assert {r.predicted for r in nothing} == {0} and X.score_documents(docs.limit(0), X.ToxicModel(None)).count() == 0
