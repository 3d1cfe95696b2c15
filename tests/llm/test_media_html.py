import hashlib
import math
import re
import zlib
from html import unescape

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from rowloom.llm import html_text as H
from rowloom.llm import media as M

RNG = np.random.default_rng(3)
PAYLOADS = [b"", b" " * 192, bytes(range(256)), RNG.bytes(5000), b"\x80" * 3000, b"\x80" * 50 + b"\x81" + b"\x80" * 900 + b"\x7f\x00\xff", RNG.choice(np.array([126, 127, 128, 129, 130, 0, 255], np.uint8), 4000).tobytes(),
            RNG.choice(np.array([128, 129], np.uint8), 20000, p=[0.97, 0.03]).tobytes()]


def test_payloads_come_back():
    files = M.encode_batch(PAYLOADS)
    got = M.decode_batch(files)
    assert [p for p, _ in got] == PAYLOADS
    assert files == [M.encode_batch([p])[0] for p in PAYLOADS]
    for (_, t), (_, alone) in zip(got, [M.decode_batch([f])[0] for f in files], strict=True):
        assert (t == alone).all()
    assert M.encode_batch([]) == [] and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" and b"\xff\xc2" in f for f in files)


def test_tensor_against_plain_formula():
    (payload, rgb), = M.decode_batch(M.encode_batch([PAYLOADS[3][:384]]))
    c = np.frombuffer(payload, np.uint8).astype(float).reshape(6, 64) - 128
    spots = M.zigzag()
    assert spots[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(spots) == list(range(64))
    planes = []
    for block in c:
        f = np.zeros(64)
        f[spots] = block
        f = f.reshape(8, 8)
        planes.append([[sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    s = np.clip(np.array(planes) + 128, 0, 255)
    y = np.block([[s[0], s[1]], [s[2], s[3]]])
    cb, cr = (np.kron(x, np.ones((2, 2))) - 128 for x in (s[4], s[5]))
    want = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    assert rgb.shape == (16, 16, 3) and np.abs(rgb - want).max() <= 2


@pytest.mark.parametrize("damage", [lambda f: f[:100], lambda f: f[:-300], lambda f: b"GIF" + f, lambda f: f.replace(b"\xff\xc2", b"\xff\xc0", 1)])
def test_damaged_files_raise(damage):
    with pytest.raises(ValueError):
        M.decode_batch([damage(M.encode_batch([PAYLOADS[3]])[0])])


def test_media_query(spark):
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = M.op1_media(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = M.pad(rows[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(rows[r.doc_id]), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:])) and len(want) % 192 == 0 < len(want)
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)


def test_media_columns(spark):
    """Columns of the outputs' names are replaced, all others kept; repeated rows are alike."""
    df = spark.createDataFrame([(1, "é" * 400, "x", 5), (2, None, "y", 6), (2, "", "y", 7), (2, "", "y", 7)], "doc_id bigint, text string, payload string, width int")
    df = df.withColumn("media", F.lit("old")).withColumn("RGB", F.lit(1)).withColumn("feature", F.lit(2))
    stored = M.store_payloads(df, "text")
    assert stored.columns == ["doc_id", "text", "payload", "width", "RGB", "feature", "media"]
    got = M.load_media(stored).sort("doc_id").collect()
    assert M.load_media(stored).columns == ["doc_id", "text", "feature", "media", "payload", "width", "height", "rgb"]
    assert bytes(got[0].payload) == M.pad(("é" * 400).encode()) and bytes(got[1].payload) == b" " * 192 and len(got[0].rgb) == got[0].width * got[0].height * 3
    assert got[2].rgb == got[3].rgb == got[1].rgb and got[0].text == "é" * 400
    said = M.media_digests(stored).sort("doc_id").collect()
    assert said[0].payload_sha256 == hashlib.sha256(got[0].payload).hexdigest() and said[0].media_bytes == len(got[0].media) and said[1].feature == said[2].feature
    assert M.store_payloads(df.limit(0), "text").count() == 0 and M.media_digests(stored.limit(0)).count() == 0


def test_long_payloads_are_strips(spark):
    """Texts of more than a picture: strips of one width, one above the other, each as it is alone."""
    text = "".join(f"{i}, " for i in range(500_000))
    assert len(text) > 2 * M.PIECE
    payload = M.pad(text.encode())
    (file, small), (back, rgb) = M.encode_payloads([payload, b"a" * 192]), M.decode_batch(M.encode_payloads([payload]))[0]
    assert back == payload and rgb.shape[1] == 16 and file.count(b"\xff\xd8") >= 3
    first = M.decode_batch(M.encode_batch([payload[: M.PIECE]]))[0][1]
    assert (rgb[: len(first)] == first).all()
    whole = M.Feature()
    whole.add(rgb)
    df = spark.createDataFrame([(1, text), (2, "a" * 192)], "doc_id bigint, text string")
    got = M.media_digests(M.store_payloads(df, "text")).sort("doc_id").collect()
    assert (got[0].payload_bytes, got[0].payload_sha256, got[0].feature) == (len(payload), hashlib.sha256(payload).hexdigest(), str(whole))
    assert got[0].media_sha256 == hashlib.sha256(file).hexdigest() and got[1].media_sha256 == hashlib.sha256(small).hexdigest()


def test_pages_against_their_source(spark):
    """The table's pages have one article of h1 and p; what is in it is known without a parser."""
    got = {r.page_id: r for r in H.op5_html_text(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def text(html):
    return H.main_text(H.parse(html)[0])


def test_page_cases():
    assert text(None) == text("") == text("<p></p>") == "" and text("plain &lt;b&gt; &amp;amp &#233;\n x") == "plain <b> &amp é x"
    page = "<body><header><h1>Site</h1></header><nav><p>Menu</p></nav><main><header><h1>T</h1></header><p>One<b>two<br>three<p>Four</b><div class='share-box'>S</div><form><p>F</p></form><section id=comments><p>C</p></section><aside>A</aside><script>'</p>x'</script></main><div class='cookie-notice'>N</div><footer>E"
    assert text(page) == "T\nOnetwo three\nFour"
    assert text("<article><p>a<p>b</article></div></p>stray") == "a\nb" and text("<ARTICLE><P>x<!-- <p>no</p> -->y</P><p>cut <a href='q") == "xy\ncut"
    assert text("<div><p>Long text here</p></div><ul><li><a href=x>link</a></li></ul><div class=ad>Buy</div>") == "Long text here"


def test_names_with_a_word_of_noise_stay_in_articles():
    page = "<article><h2 id=ad-hoc-networks>Ad hoc</h2><section id='related-work'><p>Work</p></section><div class='social-impact'>Impact</div><p id=comments>Place</p><math><mi>x</mi></math><div class='ad-box'>Buy</div><footer>Foot</footer></article>"
    assert text(page) == "Ad hoc\nWork\nImpact\nPlace\nx"
    assert text("<div class='ad hoc'>Buy</div><div class='related-work'>Work</div><div id='main-menu'>M</div>") == "Work"


def test_unclosed_quotes_and_time():
    from time import process_time

    assert text("<p>a<a href='x>b</a><p>c") == "ab\nc" and text("<p>a<b title=\"q>it's</b> <i>c</i>") == "ait's c"
    began = process_time()
    for page in ("<a '" * 50_000, "<a '>" * 50_000, "<a \"'" * 50_000 + ">", "<!--" * 50_000, "<" * 200_000, "<div>" * 900 + "x" * 10**6):
        text(page)
    assert process_time() - began < 10


def test_long_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>Word {i} and more</p>" for i in range(40_000)) + "</article>"
    pages = [(1, "http://l/1", long), (1, "http://l/1", long), (2, "http://l/2", "<p>x</p>"), (2, "http://l/2", "<p>x</p>")]
    got = sorted((r.page_id, r.n_chars, r.text[-19:]) for r in H.extract(spark.createDataFrame(pages, "page_id int, url string, html string")).collect())
    assert got[0] == got[1] == (1, sum(len(f"Word {i} and more") + 1 for i in range(40_000)) - 1, "Word 39999 and more") and got[2] == got[3] == (2, 1, "x")


def entropy(values):
    """Plain: of the values' shares, over that of as many different ones."""
    n = len(values)
    return -sum(values.count(v) / n * math.log(values.count(v) / n) for v in set(values)) / math.log(n)


def test_tree_decides_on_hosts_without_articles(spark):
    """Unmarked boilerplate of several kinds, told from the story by its diversity alone: with the tree and without."""
    story = lambda h, i: f"<div class=text><h1>Head {h} {i}</h1><p>Story {i} of {h} has {i * 7} words</p><p>And more of {i}</p></div>"
    pages = []
    for h in range(4):
        for i in range(12):
            slogan = f"<div class=slogan><p>Best site no {h}</p></div>" if h % 2 else ""
            legal = f"<div class=end><p>All rights of {h}</p><p>Since 19{h}0</p></div>"
            half = f"<div class='related-story'><p>{'First' if i % 4 else 'Second'} pick</p></div>"  # weak mark, some diversity
            pages.append((h * 100 + i, f"http://h{h}/{i}", f"<html><body>{slogan}{half}{story(h, i)}{legal}</body></html>"))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    on, off = ({r.page_id: r.text for r in H.extract(df, tree=t).collect()} for t in (True, False))
    for h in range(4):
        for i in range(12):
            want = f"Head {h} {i}\nStory {i} of {h} has {i * 7} words\nAnd more of {i}"
            assert on[h * 100 + i] == want and off[h * 100 + i] != want and want in off[h * 100 + i]
    picks = ["First" if i % 4 else "Second" for i in range(12)]
    got = {(r.host, r.path.rpartition("/")[2]): r.diversity for r in H.style_tree(df).collect()}
    assert abs(got["h0", "div.related-story ~"] - entropy(picks)) < 1e-9 and got["h0", "div.end"] == 0 and got["h1", "div.slogan"] == 0 and abs(got["h2", "div.text"] - 1) < 1e-9


def test_a_sign_that_begins_no_tag_is_text():
    assert text("<p>price < 5 euros today") == "price < 5 euros today" and text("a < b and c <3 <") == "a < b and c <3 <"
    assert text("<p>x < y <b") == "x < y" and text("<p>x < y </") == "x < y" and text("<p>x < y <!-") == "x < y"


def test_style_tree_cuts_what_repeats(spark):
    pages = [(i, f"http://a.b/{i}", f"<div class=top><p>Same words</p></div><div class=c{i}><p>Own text {i} here</p></div>", "x") for i in range(12)]
    pages += [(100, None, None, "x"), (101, "odd", "<p>alone</p>", "x"), (102, "http://other/", "<div class=top><p>Same words</p></div>", "x"), (None, "http://a.b/z", "", "x")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string, noise string")).collect()}
    assert all(got[i] == f"Own text {i} here" for i in range(12)) and (got[100], got[101], got[102], got[None]) == ("", "alone", "Same words", "")
    assert H.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string, noise string").limit(0)).count() == 0


def test_style_tree_decides_within_and_beside_articles(spark):
    story = lambda i: f"<p>Story {i} tells of {i * i} things</p>"
    inside = [(i, f"http://in/{i}", f"<article><h1>Title {i}</h1><div class=note><p>Printed by us</p></div>{story(i)}</article><div class=end>Same end</div>") for i in range(12)]
    beside = [(100 + i, f"http://cards/{i}", f"<div class=story>{story(i)}</div><article class=card><p>Card {i}</p></article><div class=end>Same end</div>") for i in range(12)]
    copies = [(200 + i, f"http://copies/{i}", f"<article><h1>One title</h1>{story(1)}</article>") for i in range(12)]
    few = [(300, "http://few/", f"<article><p>Only</p></article><div>{story(2)}</div>")]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(inside + beside + copies + few, "page_id bigint, url string, html string")).collect()}
    plain = lambda i: story(i)[3:-4]
    assert all(got[i] == f"Title {i}\n{plain(i)}" for i in range(12))
    assert all(got[100 + i] == f"{plain(i)}\nCard {i}" for i in range(12))
    assert all(got[200 + i] == f"One title\n{plain(1)}" for i in range(12)) and got[300] == "Only"
