"""Secret scans with a worklist of decoded layers.

A text is scanned for the base kinds. It also goes on a worklist; what is taken from the list is searched for encoded
parts, each decoding is a new layer that is scanned and goes on the list in turn, until no layer is left. Layers that
were met before, at the same place of the text, end there, so encodings that yield themselves end too. Layers:

- url: ``%XX`` sequences, and unicode: ``\\uXXXX``, ``\\UXXXXXXXX``, ``\\xXX`` and ``&#N;`` escapes, are replaced
  within the whole text, so a secret may reach from plain into encoded parts;
- base64, of either alphabet, of 16 characters or more, also where other letters are glued to its front: the three other
  alignments are read too, where they hold readable text or a compressed stream. Lines are joined over line breaks, indents, quote marks and
  written ``\\n``: lines of one width with the first and a shorter last one, and whole runs of lines up to padding.
  Bytes are read as UTF-8 or else one by one (Latin-1), and with zero bytes also as UTF-16, so none are left out;
- compressed: gzip, zlib, bzip2 and xz streams anywhere in a layer whose characters are bytes: decoded base64, bytes
  written as url or unicode escapes, the output of another stream. The members of a stream are joined.

Every layer keeps where its characters come from, so a span found in it is told in code points of the original text:
in full width for the encoded parts that it touches. Spans of layers are named ``layer>kind``. Percent signs that are
encoded DEEP times over or more are unwrapped in one step.

What a compressed stream unfolds to is scanned whole, in windows of WINDOW bytes that overlap by OVERLAP, so that memory
is bounded whatever its size: each window is a layer. An encoded part that is longer than the overlap and crosses the
end of a window is read in two parts. An xz stream that wants more than XZ_MEMORY to unfold is itself reported, as a
span of kind ``oversize``.

Cases: null and empty texts have no span. Repeated rows are scanned alike; no rows give no rows. Other columns are
neither read nor returned by the query; :func:`scan_documents` keeps them."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import table

# The base kinds, in order, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Bytes of an unfolded stream that are scanned at once, of which so many again with the next; memory for xz.
WINDOW, OVERLAP, XZ_MEMORY = 1 << 24, 1 << 20, 1 << 28
#: Levels of encoded percent signs that are too many to take one by one.
DEEP = 8
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_URL = re.compile(rf"(?:%(?:(?:25){{{DEEP},}})?[0-9A-Fa-f]{{2}})+")
_DEEP = re.compile(rf"%(?:25){{{DEEP},}}(?=[0-9A-Fa-f]{{2}})")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_FORM = re.compile(r"(?:%[0-9A-Fa-f]{2}|\+)+")
_WRITTEN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'\"])+")
_WRITTEN_ONE = re.compile(r"\\(?:[ux]([0-9A-Fa-f]+)|(.))")
_CONTROLS = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0", strict=True))
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE_END = r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t>]*"
_BREAK = re.compile(_LINE_END)
_WRAPPED = re.compile(rf"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\n))[A-Za-z0-9+/_-]++={{0,2}}(?:{_LINE_END}[A-Za-z0-9+/_-]++={{0,2}})+")
_URLSAFE = str.maketrans("-_", "+/")
#: Where a compressed stream may begin, and looser, before written controls are replaced.
_PACKED = re.compile("\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P)|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
_HINT = re.compile("\x1f\x8b|BZh[1-9]|\xfd7zXZ|x[\x01\x5e\x9c\xda]")
_ZEROS = re.compile("\0*")
#: What makes another alignment of base64 worth a layer.
_TELLING = re.compile(rb"[\t\n\r\x20-\x7e]{14}|(?:[\t\n\r\x20-\x7e]\0){14}|\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
#: Whether there may be anything encoded in a text.
_MORE = re.compile(rf"%[0-9A-Fa-f]{{2}}|\\[uUx]|&#|[A-Za-z0-9+/_-]{{16}}|{_HINT.pattern}|[A-Za-z0-9+/_-]={{0,2}}{_LINE_END}[A-Za-z0-9+/_-]")
#: No base kind is shorter, and no decoding is longer but a decompression.
_LEAST = 14

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds: matches from the left without overlap within a kind."""
    out: list[Span] = []
    raw = text.encode().lower()
    if any(k in raw for k in _KEYWORDS):
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


@dataclass
class Layer:
    """A text and where its parts come from: (start, end in the layer, start, end in the original, whole), without
    gaps and in order in both. A whole part maps to its full source; any other maps character by character."""

    text: str
    name: str
    parts: list[tuple[int, int, int, int, bool]]

    def __post_init__(self) -> None:
        self.starts = [p[0] for p in self.parts]
        self.wholes = [0, *accumulate(p[4] for p in self.parts)]

    def touched(self, start: int, end: int) -> tuple[int, int]:
        """The parts from the first to before the last that ``[start, end)`` touches."""
        return max(0, bisect_right(self.starts, start) - 1), bisect_left(self.starts, end)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The original span of ``[start, end)``, and whether it touches a decoded part."""
        i, j = self.touched(start, end)
        if i >= j:
            return 0, 0, False
        a, _, x, _, whole = self.parts[i]
        c, _, v, w, last = self.parts[j - 1]
        return x if whole else x + start - a, w if last else v + end - c, self.wholes[j] > self.wholes[i]


def _escapes(text: str) -> str:
    units = [int(u or x, 16) if u or x else int(d) for u, x, d in _ESCAPE.findall(text)]
    if any(n > 0x10FFFF for n in units):
        return text
    return "".join(map(chr, units)).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _percent(text: str) -> str:
    return bytes.fromhex(_DEEP.sub("%", text).replace("%", "")).decode("utf-8", "replace")


def _percent_bytes(text: str) -> str:
    return bytes.fromhex(_DEEP.sub("%", text).replace("+", "%20").replace("%", "")).decode("latin-1")


def _written(text: str) -> str:
    return _WRITTEN_ONE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _CONTROLS.get(m[2], m[2]), text)


def _replaced(layer: Layer, name: str, pattern: re.Pattern, decode) -> Layer | None:
    text, parts, at, size = [], [], 0, 0

    def plain(a: int, b: int) -> None:
        nonlocal size
        if a >= b:
            return
        for p, q, x, y, whole in layer.parts[slice(*layer.touched(a, b))]:
            left, right = max(a, p), min(b, q)
            if left < right:
                parts.append((size + left - a, size + right - a, x, y, True) if whole else (size + left - a, size + right - a, x + left - p, x + right - p, False))
        text.append(layer.text[a:b])
        size += b - a

    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new == m[0]:
            continue
        plain(at, m.start())
        x, y, _ = layer.source(*m.span())
        parts.append((size, size + len(new), x, y, True))
        text.append(new)
        size += len(new)
        at = m.end()
    if not at:
        return None
    plain(at, len(layer.text))
    return Layer("".join(text), f"{layer.name}>{name}" if layer.name else name, parts)


def _kind(text: str, at: int) -> str | None:
    """The format of a compressed stream that begins there."""
    head = text[at : at + 6]
    if head.startswith("\x1f\x8b"):
        return "gzip"
    if head.startswith("BZh"):
        return "bzip2"
    if head == "\xfd7zXZ\0":
        return "xz"
    a, b = (*map(ord, head[:2]), 0, 0)[:2]
    return "zlib" if a & 15 == 8 and a >> 4 < 8 and b < 256 and (a << 8 | b) % 31 == 0 else None


def _unfolded(text: str, start: int, kind: str) -> Iterator[tuple[bytes, int, bool]]:
    """The stream at ``start`` of a text of bytes, all members: pieces of what it unfolds to, each with the end of what
    was read for it and whether a member is complete there. A damaged or cut stream gives what comes before."""
    make = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(memlimit=XZ_MEMORY)}[kind]
    d, at, step = make(), start, 4096
    while at < len(text):
        piece = text[at : at + step]
        try:
            data = piece.encode("latin-1")
        except UnicodeEncodeError as e:
            data = piece[: e.start].encode("latin-1")
        if not data:
            return
        at, step = at + len(data), min(2 * step, 1 << 20)
        while True:
            got = d.decompress(data, OVERLAP)
            if d.eof:
                yield got, at - len(d.unused_data), True
                break
            yield got, at, False
            data = d.unconsumed_tail if kind in ("gzip", "zlib") else b""
            if not data and (kind in ("gzip", "zlib") and len(got) < OVERLAP or kind in ("bzip2", "xz") and d.needs_input):
                break
        if d.eof:
            at -= len(d.unused_data)
            after = _ZEROS.match(text, at).end()
            if kind == "zlib" or _kind(text, after) != kind:
                return
            d, at, step = make(), after, 4096


def _unpacked(text: str, start: int) -> tuple[str, int, bool, bool, bytes | None] | None:
    """Format, end, whether it is complete, whether it wants too much memory, and what it unfolds to, None if that is
    more than WINDOW; None if nothing comes out."""
    if (kind := _kind(text, start)) is None:
        return None
    out: list[bytes] | None = []
    size, end, complete = 0, start, False
    try:
        for got, end, complete in _unfolded(text, start, kind):
            size += len(got)
            if out is not None:
                out.append(got)
                if size > WINDOW:
                    out = None
    except (zlib.error, OSError, EOFError):
        complete = False
    except lzma.LZMAError as e:
        complete = False
        if not size and "emory" in str(e):
            return kind, min(len(text), start + 6), False, True, b""
    return (kind, end, complete, False, None if out is None else b"".join(out)) if size else None


def _windows(text: str, start: int, kind: str) -> Iterator[bytes]:
    """What a long stream unfolds to, in overlapping windows that end with a line where there are lines."""
    held = bytearray()
    try:
        for got, _, _ in _unfolded(text, start, kind):
            held += got
            if len(held) >= WINDOW:
                cut = held.rfind(b"\n", WINDOW - OVERLAP) + 1 or len(held)
                yield bytes(held[:cut])
                del held[: max(1, cut - OVERLAP)]
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        pass
    yield bytes(held)


def _texts(raw: bytes) -> Iterator[str]:
    """What bytes say: UTF-8 or else a character each, which compressed streams need too; with zero bytes also UTF-16
    of either order and alignment."""
    plain = raw.decode("latin-1")
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = plain
    yield text
    if text != plain and _PACKED.search(plain):
        yield plain
    if b"\0" in raw:
        for skip in (0, 1):
            for order in ("utf-16-le", "utf-16-be"):
                yield raw[skip:].decode(order, "replace")


def _packed_layers(layer: Layer, found: set[Span]) -> Iterator[Layer]:
    starts = {m.start() for m in _PACKED.finditer(layer.text)}
    starts.update(a for a, _, _, _, whole in layer.parts if whole and _kind(layer.text, a))
    done = 0
    for at in sorted(starts):
        if at < done or (inner := _unpacked(layer.text, at)) is None:
            continue
        kind, to, complete, refused, raw = inner
        if complete:
            done = to
        start, end, _ = layer.source(at, to)
        name = f"{layer.name}>{kind}" if layer.name else kind
        if refused:
            found.add((start, end, f"{name}>oversize"))
        for window in _windows(layer.text, at, kind) if raw is None else [raw] if raw else ():
            for text in _texts(window):
                yield Layer(text, name, [(0, len(text), start, end, True)])


def _base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and characters of base64, on a line or over lines. A line is in a few runs at most."""
    for m in _BASE64.finditer(text):
        yield *m.span(), m[0].rstrip("=")
    for m in _WRAPPED.finditer(text):
        cuts = [x.span() for x in _BREAK.finditer(text, *m.span())]
        lines = list(zip([m.start(), *(b for _, b in cuts)], [*(a for a, _ in cuts), m.end()], strict=True))
        size, padded, n = [b - a for a, b in lines], [text[b - 1] == "=" for _, b in lines], len(lines)
        runs, begin = set(), 0
        for i in range(n):
            if padded[i] or i == n - 1:  # all up to the padding, with or without a first word that isn't part of it
                runs |= {(begin, i + 1), (begin + 1, i + 1)}
                begin = i + 1
            if i + 1 < n and not padded[i] and (not i or size[i] != size[i - 1] or padded[i - 1]):
                j = i + 1
                while j < n and size[j] == size[i + 1] and not padded[j - 1]:
                    j += 1
                if j < n and size[j] < size[i + 1] and not padded[j - 1]:
                    j += 1
                runs.add((i, j))
        for i, j in sorted(runs):
            if j - i > 1 and len(body := "".join(text[a:b] for a, b in lines[i:j]).rstrip("=")) >= 16:
                yield lines[i][0], lines[j - 1][1], body


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    name = f"{layer.name}>base64" if layer.name else "base64"
    for at, to, body in _base64_runs(layer.text):
        start, end, _ = layer.source(at, to)
        for skip in range(4):  # the first is the run as it stands
            whole = body[skip : len(body) - ((len(body) - skip) % 4 == 1)]
            raw = base64.b64decode(whole.translate(_URLSAFE) + "=" * (-len(whole) % 4))
            if skip and not _TELLING.search(raw) or len(raw) < _LEAST and not _kind(raw[:6].decode("latin-1"), 0):
                continue
            for text in _texts(raw):
                yield Layer(text, name, [(0, len(text), start, end, True)])


def _decoded(layer: Layer, found: set[Span]) -> Iterator[Layer]:
    """What is encoded in a layer, each part a new layer."""
    if "%" in layer.text and (x := _replaced(layer, "url", _URL, _percent)):
        yield x
        if "\ufffd" in x.text:  # bytes that are no UTF-8
            views = (_replaced(layer, "url", pattern, _percent_bytes) for pattern in (_URL, _FORM))
            yield from (v for v in views if v and _PACKED.search(v.text))
    if ("\\" in layer.text or "&#" in layer.text) and (x := _replaced(layer, "unicode", _UNICODE, _escapes)):
        yield x
        if _HINT.search(x.text) and (v := _replaced(layer, "unicode", _WRITTEN, _written)):
            yield v
    yield from _packed_layers(layer, found)
    yield from _base64_layers(layer)


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """``base`` with the spans of all layers. The worklist holds what is still to come of each layer under way, so that
    one layer of each depth is in memory."""
    found: set[Span] = set()
    seen: set[tuple[bytes, int, int]] = set()
    work = [_decoded(Layer(text, "", [(0, len(text), 0, len(text), False)]), found)]
    while work:
        if (x := next(work[-1], None)) is None:
            work.pop()
            continue
        key = (hashlib.sha256(x.text.encode("utf-8", "surrogatepass")).digest(), x.parts[0][2], x.parts[-1][3])
        if key in seen:
            continue
        seen.add(key)
        for start, end, kind in base_spans(x.text.encode("utf-8", "replace").decode() if not x.text.isascii() else x.text):
            a, b, decoded = x.source(start, end)
            if decoded:
                found.add((a, b, f"{x.name}>{kind}"))
        if _MORE.search(x.text) or any(p[4] and _kind(x.text, p[0]) for p in x.parts):
            work.append(_decoded(x, found))
    return [*base, *found]


def render(spans: list[Span]) -> str:
    place = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], place.get(s[2], len(KINDS)), s[2], s[1])))


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, all_spans(text, base)


def _scanned(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    kinds = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            sha, spans = [], []
            for text in b.column(b.num_columns - 1).to_pylist():
                base, every = scan_text(text)
                for c, kind in zip(counts, KINDS, strict=True):
                    c.append(sum(k == kind for _, _, k in base))
                sha.append(hashlib.sha256(render(base).encode()).hexdigest())
                spans.append(render(every))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=[*keep, *[n for n, _ in kinds]])

    return df.select(*keep, F.col(text_col).alias("_scanned_text")).mapInArrow(run, T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, k) for n, k in kinds]]))


def scan_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the counts and spans; columns of these names are replaced."""
    return _scanned(df, text_col, [c for c in df.columns if c not in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op7_secrets(spark, sf_dir):
    return _scanned(table(spark, sf_dir, "documents"), "text", ["doc_id"])
