"""Main text of web pages by a site style tree.

The pages of a host are merged: an element is known by its path of tags, classes and marks. For each path the tree counts
in how many pages it occurs, its presentation styles (the sequences of its children) and its contents. Its diversity is
the greater of their normalised entropies over the host's pages: what looks and reads the same on many pages has none.
The importance of a branch is its diversity times the weights that its place gives it, and branches below THRESHOLD are
cut from each page, with all that is in them:

- STRONG for what is marked through and through as a menu, header, footer, sidebar, notice, advert, form or reader
  comment, by its tag, role or the whole of a class or id, since menus and adverts of varying words are diverse too;
- WEAK for a class or id that has such a word among others (``social-impact``): half the diversity will not do;
- ARTICLE for what is in an article or main element (outside of strong marks), BESIDE for what is next to one on its
  page: only the most diverse branches of the host pass for a story that stands beside teaser cards;
- LINKED for a block outside of articles that is links for the most part.

A path has the diversity UNKNOWN if it is on fewer than MIN_PAGES pages of the host or a tenth of them; in an article,
on fewer than ARTICLE_SHARE of the pages that have the article, or if the articles as a whole are copies of each other
(less than THRESHOLD diverse). An article's root, and what is above it, stay with it. What an article says counts for
the diversity of its own branches, not of those above it.

Pages are parsed once into a table of (host, path, style, content), which is aggregated by (host, path, style) and (host,
path, content), so a hot host is spread. Only the diversities that can cut a branch or keep it beside an article are
joined to the host's pages: paths on a tenth of the pages, so at most ten times the mean number of paths a page. Words
that repeat in elements of the same path as the story's (one of many plain paragraphs) are one branch with it and stay.

Cases: null and empty html give the empty text; a null or odd url counts as the host ''. Unclosed elements end with
their parents or the page; stray end tags are passed over. A tag whose quote is not closed ends at the next '>'; a tag
cut off by the end of the page ends the text; a '<' that begins no tag is text. Repeated pages are treated alike. No rows
give no rows. Other columns are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import table, written
from rowloom.llm.words import slices

THRESHOLD, MIN_PAGES, PAGE_SHARE, ARTICLE_SHARE, UNKNOWN = 0.2, 3, 0.1, 0.9, 0.75
STRONG, WEAK, ARTICLE, BESIDE, LINKED = 0.15, 0.5, 2.0, 0.25, 0.15
#: What a path's element is marked with; no tag or class has a space. An article's root; strong and weak marks.
ROOT, IS_STRONG, IS_WEAK = " *", " !", " ~"

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset("nav aside footer form button select textarea dialog menu search fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Words in class or id that mark noise anywhere, those that do outside of an article, and those that say nothing.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond disqus nav navbar navigation menu breadcrumb breadcrumbs sidebar cookie cookies consent notice popup modal share sharing social related newsletter subscribe pagination widget login signup".split())
OUTER_WORDS = frozenset("header footer banner masthead topbar toolbar alert".split())
PLAIN_WORDS = frozenset("area bar block box button buttons container content form group holder inner item items link links list main outer panel section site slot the top bottom left right unit wrap wrapper".split())
_LINK_TO = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figure table tr td th caption".split())
_CLOSES_P = BLOCKS - {"html", "body"}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>", re.S)
_OPEN = re.compile(r"<[A-Za-z/!?]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Element:
    tag: str
    path: str
    strong: bool  # or within such an element
    article: bool
    children: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)


@dataclass
class Block:
    path: str
    article: bool
    text: str
    linked: int


def _attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}


def _mark(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """How an element is marked by its tag, role and names. A heading's or paragraph's id is a place to link to."""
    if tag in NOISE_TAGS or (tag == "header" and not in_article) or "hidden" in attributes:
        return IS_STRONG
    if not attributes:
        return ""
    if attributes.get("role", "").lower() in NOISE_ROLES or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return IS_STRONG
    if tag in ("body", "html"):
        return ""
    mark, noise = "", NOISE_WORDS if in_article else NOISE_WORDS | OUTER_WORDS
    for name in [*attributes.get("class", "").split(), *(attributes.get("id", "").split() if tag not in _LINK_TO else ())]:
        words = set(_WORD.findall(_CAMEL.sub(r"\1 \2", name).lower()))
        if words & noise:
            if words <= noise | PLAIN_WORDS:
                return IS_STRONG
            mark = IS_WEAK
    return mark


def parse(html: str | None) -> tuple[list[Block], list[Element]]:
    """The page's blocks in order, and its block elements."""
    root = Element("", "", False, False)
    stack, elements, blocks = [root], [root], []
    text: list[str] = []
    linked = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            e = stack[-1]
            blocks.append(Block(e.path, e.article, joined, linked))
            e.texts.append(joined)
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            plain = unescape(raw) if "&" in raw else raw
            text.append(plain)
            if anchors:
                linked += len(plain.strip())

    html = html or ""
    last = html.rfind(">") + 1  # no tag ends behind it
    while at < last and (m := _TOKEN.search(html, at, last)) is not None:
        say(html[at : m.start()])
        at = m.end()
        if (m[2] or m[5]) is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(html)
            continue
        tag, ends, rest = (m[2] or m[5]).lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if ends:
            if tag == "a":
                anchors = max(0, anchors - 1)
            if tag in BLOCKS:
                deep = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if deep:
                    flush()
                    del stack[deep:]
            continue
        if tag in RAW:
            if not rest.endswith("/") or tag in ("script", "style", "title"):
                close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            anchors += 1
        elif tag in BLOCKS:
            flush()
            anchors = 0
            if tag in _CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        del stack[i:]
                        break
                    if stack[i].tag not in ("p", "li") or stack[i].tag == tag:
                        if stack[i].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                            del stack[i:]
                        break
            if tag in VOID:
                continue
            up, attributes = stack[-1], _attributes(rest)
            marks = ".".join(sorted(re.sub(r"\d+", "", x) for x in attributes.get("class", "").split()))
            key = f"{tag}.{marks}" if marks else tag
            mark = _mark(tag, attributes, up.article)
            strong = up.strong or mark == IS_STRONG
            article = not strong and (up.article or tag in ("article", "main") or attributes.get("role") in ("main", "article"))
            key += mark + (ROOT if article and not up.article else "")
            e = Element(tag, f"{up.path}/{key}", strong, article)
            if not up.children or up.children[-1] != key:
                up.children.append(key)
            stack.append(e)
            elements.append(e)
    cut = _OPEN.search(html, at)
    say(html[at : cut.start() if cut else len(html)])
    flush()
    return blocks, elements


def main_text(blocks: list[Block], paths: list[str] | None = None, diversities: list[float] | None = None) -> str:
    """The blocks whose branches are important, by the diversity of the host's ``paths``."""
    known = dict(zip(paths or (), diversities or (), strict=True))
    has_article = any(b.article for b in blocks)
    importance: dict[tuple[str, bool], float] = {}

    def least(path: str, article: bool, above: int) -> float:
        """Of the branch and those that it is in, down from the length ``above``."""
        if len(path) <= above:
            return 1.0
        if (path, article) not in importance:
            own = known.get(path, UNKNOWN) * (ARTICLE if article else BESIDE if has_article else 1.0)
            own *= STRONG if path.endswith(IS_STRONG) else WEAK if path.endswith(IS_WEAK) else 1.0
            importance[path, article] = min(own, least(path.rpartition("/")[0], article, above))
        return importance[path, article]

    def stays(b: Block) -> bool:
        own = least(b.path, b.article, b.path.index(ROOT) + len(ROOT) if b.article else 0)
        if not b.path and has_article:  # outside of all elements
            own = UNKNOWN * BESIDE
        return own * (LINKED if not b.article and 2 * b.linked > len(b.text) else 1.0) >= THRESHOLD

    return "\n".join(b.text for b in blocks if stays(b))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """pages(url, html) to host, path, pages, diversity, root (the article's path, or empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in slices(batches, 1, 500):
            rows: list[tuple[str, str, int, int]] = []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                styles: dict[str, list[str]] = {}
                contents: dict[str, list[str]] = {}
                for e in parse(html)[1]:
                    if e.path:
                        styles.setdefault(e.path, []).append(" ".join(e.children))
                        path, least = e.path, e.path.index(ROOT) if e.article else 0
                        while len(path) > least:  # what a branch says is part of its parents' content, up to the article
                            contents.setdefault(path, []).extend(e.texts)
                            path = path.rpartition("/")[0]
                rows += [(host, p, xxh64_intdigest("|".join(s)) >> 1, xxh64_intdigest("\n".join(contents[p])) >> 1) for p, s in styles.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["host", "path", "style", "content"])

    seen = written(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, style long, content long"), "seen-paths")

    def entropy(what: str) -> DataFrame:
        """Over the pages, divided by its greatest value."""
        each = seen.groupBy("host", "path", what).agg(F.count("*").alias("c"))
        per = each.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"))
        return per.select("host", "path", "pages", F.when(F.col("pages") > 1, 1 - F.col("s") / (F.col("pages") * F.log("pages"))).otherwise(F.lit(1.0)).alias(what))

    both = entropy("style").join(entropy("content").drop("pages"), ["host", "path"])
    return both.select("host", "path", "pages", F.greatest("style", "content").alias("diversity"), F.regexp_extract("path", r"^(.*? \*)", 1).alias("root"))


def host_diversities(pages: DataFrame) -> DataFrame:
    """host, paths, diversities: those that decide on a branch of the host, beside or instead of UNKNOWN."""
    sizes = pages.groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("of"))
    tree = style_tree(pages).filter(F.col("pages") >= MIN_PAGES).join(sizes, "host").filter(F.col("pages") >= PAGE_SHARE * F.col("of")).drop("of")
    tree = written(tree, "style-tree")
    strong, weak = F.col("path").endswith(IS_STRONG), F.col("path").endswith(IS_WEAK)
    cuts = F.col("diversity") * F.when(weak, WEAK).otherwise(1.0) < THRESHOLD
    outer = tree.filter((F.col("root") == "") & ~strong & (cuts | (F.col("diversity") * BESIDE >= THRESHOLD)))
    roots = tree.filter((F.col("path") == F.col("root")) & (F.col("diversity") >= THRESHOLD)).select("host", "root", F.col("pages").alias("of"))
    inner = tree.filter((F.col("root") != "") & (F.col("path") != F.col("root")) & ~strong & (F.col("diversity") * ARTICLE * F.when(weak, WEAK).otherwise(1.0) < THRESHOLD))
    inner = inner.join(roots, ["host", "root"]).filter(F.col("pages") >= ARTICLE_SHARE * F.col("of"))
    every = outer.select("host", "path", "diversity").unionByName(inner.select("host", "path", "diversity"))
    listed = every.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "diversity"))).alias("e"))
    return written(listed.select("host", F.col("e.path").alias("paths"), F.col("e.diversity").alias("diversities")), "diversities")


def extract(pages: DataFrame, id_col: str = "page_id", tree: bool = True) -> DataFrame:
    """One row for each page: id, url, text, n_chars. Without ``tree`` every diversity is UNKNOWN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 500):
            texts = [main_text(parse(h)[0], n, k) for h, n, k in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col), "url", "html", host_of(F.col("url")).alias("host"))
    if tree:
        rows = rows.join(host_diversities(pages), "host", "left")
    else:
        rows = rows.withColumn("paths", F.lit(None).cast("array<string>")).withColumn("diversities", F.lit(None).cast("array<double>"))
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "url", "html", "paths", "diversities").mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
