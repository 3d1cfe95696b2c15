"""Media columns: progressive JPEG.

A payload is stored in the format's own lossless unit, the quantised coefficient: byte b is the coefficient b - 128,
in zigzag order, 64 to a block, six blocks (four luma, two chroma, 4:2:0) to a unit of 16 x 16 pixels, all
quantisers 1. The writer makes a progressive file: DC first and refined, AC in two spectral bands without their
lowest bit, then that bit by successive approximation, with restart intervals. The reader takes such files in general:
it accumulates all scans in coefficient arrays, inverse-transforms them in numpy, upsamples chroma and gives RGB
tensors of full resolution. Restart segments of a whole batch are decoded side by side, a numpy lane each.

A payload of more than PIECE bytes is stored as several pictures one after the other in its file, strips of one width
that stand below each other in the tensor, so the memory it takes is bounded by PIECE but for its bytes and tensor.

The inverse transform is exact integer arithmetic (in doubles below 2**53), so equal bytes give equal tensors.

Cases: null and empty payloads are stored as one padded unit of payload. A file that is not a progressive 8-bit JPEG of
three components, or is cut short, raises. Repeated rows give equal values. No rows give no rows. Other columns are kept
by :func:`store_payloads` and :func:`load_media`, but those of their outputs' names, which are replaced; the query reads
id and text alone."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import table

UNIT = 192
#: Units of 16 x 16 pixels between restarts, bytes of payload that are worked on at once, units of a picture's column.
RESTART = 3
CHUNK = 2_000_000
TALLEST = 4000
#: Bytes of a picture's payload: one column, so that pictures of one payload have one width.
PIECE = 2 * UNIT * TALLEST
# The scans written: (components, first and last coefficient, high bit, low bit).
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), *[((c,), a, b, 0, 1) for a, b in ((1, 5), (6, 63)) for c in range(3)], ((0, 1, 2), 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in range(3)]]
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(None)
def zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in zigzag order."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


@lru_cache(None)
def inverse_matrix() -> np.ndarray:
    """Zigzag coefficients to samples, times 2**16, rounded to integers."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    return np.rint(np.kron(basis, basis)[zigzag()] * 65536)


def code_tables() -> tuple[bytes, bytes]:
    """The DC and AC table specifications (16 code counts, then symbols), by rule: the sizes 0 to 11 in 4 bits; AC
    run-free sizes 1 to 8 in 4 bits, all other symbols in 9."""
    dc = bytes([0, 0, 0, 12, *[0] * 12, *range(12)])
    short = list(range(1, 9))
    rest = [s for s in range(256) if s not in short and (s & 15) <= 10 and not (s & 15 == 0 and s >> 4 == 15)] + [0xF0]
    return dc, bytes([0, 0, 0, len(short), 0, 0, 0, 0, len(rest), *[0] * 7, *short, *rest])


@lru_cache(None)
def encoder_table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            codes[spec[at]], sizes[spec[at]] = code, bits
            code, at = code + 1, at + 1
        code <<= 1
    return codes, sizes


@lru_cache(64)
def decoder_table(spec: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; length 0 marks no code."""
    out = np.zeros(65536, np.int32)
    code, at = 0, 16
    for bits in range(1, 17):
        for _ in range(spec[bits - 1]):
            out[code << 16 - bits : code + 1 << 16 - bits] = bits << 8 | spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


_SIZES = np.frexp(np.arange(1 << 12, dtype=np.float64))[1].astype(np.int64)


def _bit_size(v: np.ndarray) -> np.ndarray:
    """Bits of values from 0 to 4095."""
    return _SIZES[v]


# --- writing


@dataclass(frozen=True)
class Shape:
    columns: int
    rows: int

    @property
    def units(self) -> int:
        return self.columns * self.rows

    @lru_cache(512)  # noqa: B019  a few hundred shapes of small pictures
    def interleaved(self) -> np.ndarray:
        """Blocks in the order of a scan of all components; a picture's blocks are its luma, Cb, then Cr in raster order."""
        r, c = np.divmod(np.arange(self.units), self.columns)
        luma = [(2 * r + v) * 2 * self.columns + 2 * c + h for v in (0, 1) for h in (0, 1)]
        u = np.arange(self.units)
        return np.stack([*luma, 4 * self.units + u, 5 * self.units + u], axis=1).ravel()

    def component(self, c: int) -> np.ndarray:
        return np.arange(4 * self.units) if c == 0 else np.arange(self.units) + (3 + c) * self.units


def shape_of(n_bytes: int) -> Shape:
    units = max(1, -(-n_bytes // 384))
    columns = -(-units // TALLEST)
    return Shape(columns, -(-units // columns))


def _pack(segment: np.ndarray, code: np.ndarray, size: np.ndarray, n_segments: int) -> list[bytes]:
    """Bit strings of the segments from codes in stream order, padded with ones, 0xFF stuffed."""
    bits = np.bincount(segment, size, n_segments).astype(np.int64)
    n_bytes = (bits + 7) >> 3
    start = np.cumsum(n_bytes) - n_bytes
    ends = np.cumsum(size)
    first = np.cumsum(bits) - bits
    at = ends - size - first[segment] + 8 * start[segment]
    word = code.astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)  # no code is longer than 32 bits
    total = int(n_bytes.sum())
    words = total // 4 + 2
    out = np.bincount(at >> 5, (word >> np.uint64(32)).astype(np.float64), words)
    out += np.bincount((at >> 5) + 1, (word & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    filled = out.astype(">u4").view(np.uint8)[:total]
    pad = (-bits) % 8
    full = np.flatnonzero(n_bytes)
    filled[start[full] + n_bytes[full] - 1] |= ((1 << pad[full]) - 1).astype(np.uint8)
    raw = filled.tobytes()
    return [raw[a : a + n].replace(b"\xff", b"\xff\x00") for a, n in zip(start.tolist(), n_bytes.tolist(), strict=True)]


def _first_dc(values: np.ndarray, segment: np.ndarray, component: np.ndarray, spec: bytes) -> tuple[np.ndarray, ...]:
    diff = np.zeros(len(values), np.int64)
    for c in range(3):
        at = np.flatnonzero(component == c)
        v, s = values[at], segment[at]
        before = np.r_[0, v[:-1]]
        before[np.r_[True, s[1:] != s[:-1]]] = 0
        diff[at] = v - before
    codes, sizes = encoder_table(spec)
    n = _bit_size(np.abs(diff))
    extra = np.where(diff < 0, diff + (1 << n) - 1, diff)
    return segment, codes[n] << n | extra, sizes[n] + n


def _first_ac(v: np.ndarray, segment: np.ndarray, spec: bytes) -> tuple[np.ndarray, ...]:
    """v: blocks by coefficients of the band, shifted."""
    codes, sizes = encoder_table(spec)
    b, k = np.nonzero(v)
    x = v[b, k].astype(np.int64)
    fresh = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    run = k - np.where(fresh, -1, np.r_[0, k[:-1]]) - 1
    n = _bit_size(np.abs(x))
    symbol = (run & 15) << 4 | n
    code = codes[symbol] << n | np.where(x < 0, x + (1 << n) - 1, x)
    size = sizes[symbol] + n
    last = np.full(len(v), -1)
    last[b] = k
    ended = np.flatnonzero(last < v.shape[1] - 1)
    long = np.flatnonzero(run > 15)
    times = run[long] >> 4
    where = np.r_[np.repeat(long, times), np.searchsorted(b, ended, side="right")]
    block = np.r_[np.repeat(b[long], times), ended]
    mark = np.r_[np.full(int(times.sum()), 0xF0), np.zeros(len(ended), np.int64)].astype(np.int64)
    order = np.lexsort((block, where))  # an end of block stands before the next block's runs
    where, block, mark = where[order], block[order], mark[order]
    return segment[np.insert(b, where, block)], np.insert(code, where, codes[mark]), np.insert(size, where, sizes[mark])


def _refined_ac(v: np.ndarray, segment: np.ndarray, spec: bytes) -> tuple[np.ndarray, ...]:
    """v: blocks by coefficients of the band; their lowest bit is sent."""
    codes, sizes = encoder_table(spec)
    a = np.abs(v)
    n_blocks, width = v.shape
    code, size = np.zeros((n_blocks, width, 2), np.int32), np.zeros((n_blocks, width, 2), np.int8)
    old = a > 1
    code[..., 1][old], size[..., 1][old] = a[old] & 1, 1
    zb, zk = np.nonzero(a == 0)
    before = np.zeros(n_blocks * width + 1, np.int64)  # zeros before each place of the flat grid
    np.cumsum((a == 0).ravel(), out=before[1:])
    b, k = np.nonzero(a == 1)
    fresh = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
    start = np.where(fresh, 0, np.r_[0, k[:-1]] + 1)
    base = before[b * width + start]
    run = before[b * width + k] - base
    times = run >> 4
    symbol = (run & 15) << 4 | 1
    place = start.copy()
    far = np.flatnonzero(times)
    place[far] = zk[base[far] + 16 * times[far] - 1] + 1
    code[b, place, 0] = codes[symbol] << 1 | (v[b, k] > 0)
    size[b, place, 0] = sizes[symbol] + 1
    for j in range(int(times.max()) if len(times) else 0):
        some = np.flatnonzero(times > j)
        at = start[some] if j == 0 else zk[base[some] + 16 * j - 1] + 1
        code[b[some], at, 0], size[b[some], at, 0] = codes[0xF0], sizes[0xF0]
    last = np.full(n_blocks, -1)
    last[b] = k
    ended = np.flatnonzero(last < width - 1)
    code[ended, last[ended] + 1, 0], size[ended, last[ended] + 1, 0] = codes[0], sizes[0]
    used = np.flatnonzero(size.ravel())
    return segment[used // (2 * width)], code.ravel()[used].astype(np.int64), size.ravel()[used].astype(np.int64)


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload."""
    if not payloads:
        return []
    shapes = [shape_of(len(p)) for p in payloads]
    base = np.cumsum([0, *[6 * s.units for s in shapes]])
    flat = np.zeros((int(base[-1]), 64), np.int16)
    for p, s, at in zip(payloads, shapes, base, strict=False):
        flat[at : at + 6 * s.units].ravel()[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
    dc, ac = code_tables()
    scans: list[list[bytes]] = [[] for _ in payloads]
    for parts, first, final, high, low in SCRIPT:
        own = [s.interleaved() if len(parts) > 1 else s.component(parts[0]) for s in shapes]
        per = (6 if len(parts) > 1 else 1) * RESTART
        counts = [-(-len(o) // per) for o in own]
        seq = np.concatenate([o + at for o, at in zip(own, base, strict=False)])
        offset = np.cumsum([0, *counts])
        segment = np.concatenate([np.arange(len(o)) // per + at for o, at in zip(own, offset, strict=False)])
        if final == 0:
            v = flat[seq, 0].astype(np.int64)
            where = np.tile([0, 0, 0, 0, 1, 2], len(seq) // 6)
            items = _first_dc(v >> low, segment, where, dc) if not high else (segment, v & 1, np.ones(len(v), np.int64))
        else:
            v = flat[seq, first : final + 1].astype(np.int32)
            items = _refined_ac(v, segment, ac) if high else _first_ac(np.sign(v) * (np.abs(v) >> low), segment, ac)
        bits = _pack(*items, int(offset[-1]))
        head = b"\xff\xda" + struct.pack(">HB", 6 + 2 * len(parts), len(parts)) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([first, final, high << 4 | low])
        for i, (a, b) in enumerate(zip(offset, offset[1:], strict=False)):
            body = [bits[a]]
            for n, x in enumerate(bits[a + 1 : b]):
                body += [bytes([0xFF, 0xD0 + n % 8]), x]
            scans[i].append(head + b"".join(body))
    out = []
    for p, s, body in zip(payloads, shapes, scans, strict=True):
        def part(code: int, data: bytes) -> bytes:
            return bytes([0xFF, code]) + struct.pack(">H", len(data) + 2) + data

        frame = struct.pack(">BHHB", 8, 16 * s.rows, 16 * s.columns, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        out.append(b"\xff\xd8" + part(0xFE, b"payload=%d" % len(p)) + part(0xDB, bytes([0, *[1] * 64])) + part(0xC2, frame) + part(0xC4, b"\x00" + dc + b"\x10" + ac) + part(0xDD, struct.pack(">H", RESTART)) + b"".join(body) + b"\xff\xd9")
    return out


# --- reading


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    payload: int | None = None
    sampling: list[tuple[int, int]] = field(default_factory=list)
    quantisers: list[np.ndarray] = field(default_factory=list)
    #: (component, first, last, high, low, table specification, segments, blocks of each in order, component of each)
    scans: list[tuple] = field(default_factory=list)
    grid: list[tuple[int, int]] = field(default_factory=list)  # blocks across and down, whole units
    offset: list[int] = field(default_factory=list)
    blocks: int = 0


def parse(raw: bytes, at: int = 0) -> tuple[Picture, int]:
    """Headers, and the entropy-coded segments of each scan, of the picture at ``at``; where it ends."""
    try:
        return _parsed(raw, at)
    except (struct.error, IndexError, KeyError) as e:
        raise ValueError("JPEG is cut short") from e


def _parsed(raw: bytes, at: int) -> tuple[Picture, int]:
    if raw[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    pic, at, tables, quant, ids, interval = Picture(), at + 2, {}, {}, {}, 0
    while True:
        if raw[at : at + 2] == b"\xff\xd9":
            at += 2
            break
        if at + 4 > len(raw):
            raise ValueError("JPEG is cut short")
        code, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        data = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if code == 0xFE and data.startswith(b"payload="):
            pic.payload = int(data[8:])
        elif code == 0xDB:
            while data:
                wide = data[0] >> 4
                quant[data[0] & 15] = np.frombuffer(data[1 : 1 + (128 if wide else 64)], ">u2" if wide else "u1").astype(np.int64)
                data = data[129 if wide else 65 :]
        elif code == 0xC4:
            while data:
                n = 17 + sum(data[1:17])
                tables[data[0]] = data[1:n]
                data = data[n:]
        elif code == 0xDD:
            interval = struct.unpack(">H", data)[0]
        elif code == 0xC2:
            depth, pic.height, pic.width, n = struct.unpack_from(">BHHB", data)
            if depth != 8 or n != 3:
                raise ValueError("8-bit pictures of three components only")
            specs = [data[6 + 3 * i : 9 + 3 * i] for i in range(3)]
            ids = {s[0]: i for i, s in enumerate(specs)}
            pic.sampling = [(s[1] >> 4, s[1] & 15) for s in specs]
            wide, tall = max(h for h, _ in pic.sampling), max(v for _, v in pic.sampling)
            across, down = -(-pic.width // (8 * wide)), -(-pic.height // (8 * tall))
            pic.grid = [(across * h, down * v) for h, v in pic.sampling]
            pic.offset = np.cumsum([0, *[a * b for a, b in pic.grid]]).tolist()
            pic.blocks, quants = pic.offset[3], [s[2] for s in specs]
        elif code == 0xDA:
            parts = [(ids[data[1 + 2 * i]], data[2 + 2 * i]) for i in range(data[0])]
            first, final, bits = data[1 + 2 * len(parts) :][:3]
            if len(parts) > 1:
                r, c = np.divmod(np.arange(across * down), across)
                cols = [(pic.offset[k] + (r * v + y) * pic.grid[k][0] + c * h + x, k) for k, _ in parts for h, v in [pic.sampling[k]] for y in range(v) for x in range(h)]
                seq, comp, per = np.stack([q for q, _ in cols], axis=1).ravel(), np.tile([k for _, k in cols], across * down), len(cols)
            else:
                k = parts[0][0]
                h, v = pic.sampling[k]
                w, t = -(-(-(-pic.width * h // wide)) // 8), -(-(-(-pic.height * v // tall)) // 8)
                seq, per = (pic.offset[k] + np.arange(t)[:, None] * pic.grid[k][0] + np.arange(w)).ravel(), 1
                comp = np.full(len(seq), k)
            if (m := _MARKER.search(raw, at)) is None:
                raise ValueError("JPEG is cut short")
            segments = [x.replace(b"\xff\x00", b"\xff") for x in _RESTARTS.split(raw[at : m.start()])]
            at = m.start()
            step = interval * per or len(seq)
            if len(segments) != -(-len(seq) // step):
                raise ValueError("restart segments don't fit the picture")
            used = tuple(tables.get((0x10 if final else 0) | (s >> (0 if final else 4) & 15), b"") for _, s in parts)
            pic.scans.append((tuple(k for k, _ in parts), first, final, bits >> 4, bits & 15, used, segments, seq, comp, step))
        elif code in (0xC0, 0xC1, 0xC3):
            raise ValueError("not a progressive JPEG")
    if not pic.blocks:
        raise ValueError("JPEG without a frame")
    pic.quantisers = [quant[q] for q in quants]
    return pic, at


class Lanes:
    """Bit readers side by side, one a segment."""

    def __init__(self, segments: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(s + b"\0\0\0\0\0\0" for s in segments) + b"\0\0", np.uint8).astype(np.int64)
        sizes = np.array([len(s) for s in segments], np.int64)
        start = np.cumsum(sizes + 6) - sizes - 6
        self.at, self.end = 8 * start, 8 * (start + sizes + 4)
        n = len(raw) - 4
        self.window = raw[:n] << 32 | raw[1 : n + 1] << 24 | raw[2 : n + 2] << 16 | raw[3 : n + 3] << 8 | raw[4 : n + 4]

    def peek(self, lane: np.ndarray, n) -> np.ndarray:
        """The next n (up to 32) bits of the lanes."""
        at = self.at[lane]
        if (at > self.end[lane]).any():
            raise ValueError("JPEG segment is cut short")
        return (self.window[at >> 3] >> (40 - (at & 7) - n)) & ((1 << n) - 1)

    def read(self, lane: np.ndarray, n) -> np.ndarray:
        out = self.peek(lane, n)
        self.at[lane] += n
        return out

    def symbol(self, lane: np.ndarray, lookup: np.ndarray) -> np.ndarray:
        hit = lookup[self.peek(lane, 16)].astype(np.int64)
        if (hit == 0).any():
            raise ValueError("no such code in the JPEG's table")
        self.at[lane] += hit >> 8
        return hit & 255


def _signed(bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << n >> 1), bits - (1 << n) + 1, bits)


def _decode_dc(c: np.ndarray, lanes: Lanes, seq: np.ndarray, comp: np.ndarray, at: np.ndarray, end: np.ndarray, high: int, low: int, lookups: dict[int, np.ndarray]) -> None:
    before = np.zeros((len(at), 3), np.int64)
    lane = np.flatnonzero(at < end)
    while len(lane):
        blocks, kinds = seq[at[lane]], comp[at[lane]]
        if high:
            c[blocks, 0] |= (lanes.read(lane, 1) << low).astype(c.dtype)
        else:
            n = np.zeros(len(lane), np.int64)
            for k, lookup in lookups.items():
                some = kinds == k
                n[some] = lanes.symbol(lane[some], lookup)
            before[lane, kinds] += _signed(lanes.read(lane, n), n)
            c[blocks, 0] = before[lane, kinds] << low
        at[lane] += 1
        lane = lane[at[lane] < end[lane]]


def _decode_ac(c: np.ndarray, lanes: Lanes, seq: np.ndarray, at: np.ndarray, end: np.ndarray, first: int, final: int, low: int, lookup: np.ndarray) -> None:
    flat, window, lookup = c.reshape(-1), lanes.window, lookup.astype(np.int64)
    k, bit, limit = np.full(len(at), first), lanes.at.copy(), lanes.end
    while len(at):
        if (bit > limit).any():
            raise ValueError("JPEG segment is cut short")
        shift = 40 - (bit & 7)
        ahead = window[bit >> 3]
        hit = lookup[(ahead >> (shift - 16)) & 0xFFFF]
        if not hit.all():
            raise ValueError("no such code in the JPEG's table")
        length, run, n = hit >> 8, (hit >> 4) & 15, hit & 15
        span = np.where(n > 0, n, np.where(run < 15, run, 0))
        extra = (ahead >> (shift - length - span)) & ((1 << span) - 1)  # a code and its bits fit into the window
        bit += length + span
        k += run
        put = np.flatnonzero(n)
        kk = k[put]
        if (kk > final).any():
            raise ValueError("JPEG run beyond its band")
        flat[seq[at[put]] * 64 + kk] = _signed(extra[put], n[put]) * (1 << low)
        k += 1
        over = np.flatnonzero((n == 0) & (run < 15))
        if len(over):
            at[over] += (1 << run[over]) + extra[over]
            k[over] = first
        done = np.flatnonzero(k > final)
        if len(done):
            at[done] += 1
            k[done] = first
        if len(over) or len(done):
            live = at < end
            if not live.all():
                at, end, k, bit, limit = at[live], end[live], k[live], bit[live], limit[live]


def _refine_ac(c: np.ndarray, lanes: Lanes, seq: np.ndarray, at: np.ndarray, end: np.ndarray, first: int, final: int, low: int, lookup: np.ndarray) -> None:
    flat, window, lookup = c.reshape(-1), lanes.window, lookup.astype(np.int64)
    k, bit, limit = np.full(len(at), first), lanes.at.copy(), lanes.end
    skip, new, over = (np.zeros(len(at), np.int64) for _ in range(3))
    need = np.ones(len(at), bool)
    while len(at):
        if (bit > limit).any():
            raise ValueError("JPEG segment is cut short")
        ask = np.flatnonzero(need)
        if len(ask):
            b = bit[ask]
            shift = 40 - (b & 7)
            ahead = window[b >> 3]
            hit = lookup[(ahead >> (shift - 16)) & 0xFFFF]
            if not hit.all():
                raise ValueError("no such code in the JPEG's table")
            length, run, n = hit >> 8, (hit >> 4) & 15, hit & 15
            span = np.where(n > 0, 1, np.where(run < 15, run, 0))
            extra = (ahead >> (shift - length - span)) & ((1 << span) - 1)
            bit[ask] = b + length + span
            skip[ask], need[ask] = run, False
            new[ask] = np.where(n > 0, (2 * extra - 1) << low, 0)
            over[ask] = np.where((n == 0) & (run < 15), (1 << run) + extra, 0)
        place = seq[at] * 64 + k
        now = flat[place]
        old = now != 0
        fix = np.flatnonzero(old)
        if len(fix):
            b = bit[fix]
            one = (window[b >> 3] >> (39 - (b & 7))) & 1
            bit[fix] = b + 1
            v = now[fix]
            flat[place[fix]] = v + np.sign(v) * (one << low).astype(v.dtype)
        free = np.flatnonzero(~old & (over == 0))
        if len(free):
            stop = skip[free] == 0
            put = free[stop]
            flat[place[put]] = new[put]
            need[put] = True
            skip[free[~stop]] -= 1
        k += 1
        done = np.flatnonzero(k > final)
        if len(done):
            at[done] += 1
            k[done] = first
            over[done] = np.maximum(over[done] - 1, 0)
            need[done] = over[done] == 0
            live = at < end
            if not live.all():
                at, end, k, bit, limit, skip, new, over, need = (x[live] for x in (at, end, k, bit, limit, skip, new, over, need))


def coefficients(pictures: list[Picture]) -> tuple[np.ndarray, np.ndarray]:
    """All pictures' coefficients, blocks in rows, zigzag order; the first block of each picture."""
    base = np.cumsum([0, *[p.blocks for p in pictures]])
    c = np.zeros((int(base[-1]), 64), np.int16)
    turns: dict[tuple, list[tuple]] = defaultdict(list)
    for p, at in zip(pictures, base, strict=False):
        passes = [0, 0, 0]
        for scan in p.scans:
            turn = max(passes[k] for k in scan[0])
            for k in scan[0]:
                passes[k] = turn + 1
            parts = scan[0] if scan[2] == 0 else ()
            turns[turn, parts, *scan[1:6]].append((*scan[6:], int(at)))
    for (_, parts, first, final, high, low, used), scans in sorted(turns.items(), key=lambda x: x[0][0]):
        lanes = Lanes([s for segments, *_ in scans for s in segments])
        seq = np.concatenate([q + at for _, q, _, _, at in scans])
        comp = np.concatenate([k for _, _, k, _, _ in scans])
        start, end, n = [], [], 0
        for _, q, _, step, _ in scans:
            cuts = np.arange(0, len(q), step)
            start.append(cuts + n)
            end.append(np.minimum(cuts + step, len(q)) + n)
            n += len(q)
        start, end = np.concatenate(start).astype(np.int64), np.concatenate(end).astype(np.int64)
        if final == 0:
            _decode_dc(c, lanes, seq, comp, start, end, high, low, {} if high else {k: decoder_table(u) for k, u in zip(parts, used, strict=True)})
        else:
            (_refine_ac if high else _decode_ac)(c, lanes, seq, start, end, first, final, low, decoder_table(used[0]))
    return c, base


def tensors(pictures: list[Picture], c: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """RGB tensors, height x width x 3, 8-bit."""
    out = []
    matrix = inverse_matrix()
    # All pictures' blocks in one product.
    scale = np.concatenate([np.repeat(np.stack(p.quantisers), np.diff(p.offset), axis=0) for p in pictures]) if any((q != 1).any() for p in pictures for q in p.quantisers) else 1
    every = np.clip(np.floor(((c.astype(np.float64) * scale) @ matrix + 32768) / 65536) + 128, 0, 255).astype(np.int32)
    for p, at in zip(pictures, base, strict=False):
        planes = []
        wide, tall = max(h for h, _ in p.sampling), max(v for _, v in p.sampling)
        for k, (h, v) in enumerate(p.sampling):
            across, down = p.grid[k]
            samples = every[at + p.offset[k] : at + p.offset[k + 1]]
            plane = samples.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
            planes.append(np.repeat(np.repeat(plane, tall // v, axis=0), wide // h, axis=1)[: p.height, : p.width])
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # The JFIF colour transform, times 2**16.
        rgb = [y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)]
        out.append(np.clip(np.stack(rgb, axis=2), 0, 255).astype(np.uint8))
    return out


def decode_batch(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload (all coefficients, where the file tells no length) and RGB tensor of each file; a file's pictures are
    strips of its tensor."""
    parts: list[tuple[list[bytes], list[np.ndarray]]] = [([], []) for _ in files]
    for i, payload, rgb in decoded(files):
        parts[i][0].append(payload)
        parts[i][1].append(rgb)
    return [(b"".join(p), t[0] if len(t) == 1 else np.concatenate(t)) for p, t in parts]


def decoded(files: list[bytes]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Number of the file, payload and RGB tensor of each picture, decoded as many together as CHUNK allows."""
    group: list[tuple[int, Picture]] = []
    size = 0
    for i, raw in enumerate(files):
        at = 0
        while at < len(raw) or not at:
            pic, end = parse(raw, at)
            if group and size + end - at > CHUNK:
                yield from _decoded(group)
                group, size = [], 0
            group.append((i, pic))
            size, at = size + end - at, end
            if raw[at : at + 2] != b"\xff\xd8":  # whatever else follows a picture
                break
    yield from _decoded(group)


def _decoded(group: list[tuple[int, Picture]]) -> Iterator[tuple[int, bytes, np.ndarray]]:
    if not group:
        return
    pictures = [p for _, p in group]
    c, base = coefficients(pictures)
    for (i, p), a, b, rgb in zip(group, base, base[1:], tensors(pictures, c, base), strict=False):
        raw = (c[a:b] + 128).astype(np.uint8).tobytes()
        yield i, raw[: p.payload] if p.payload is not None else raw, rgb


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The file of each payload: a picture for each PIECE bytes."""
    pieces = [(i, p[at : at + PIECE]) for i, p in enumerate(payloads) for at in range(0, len(p) or 1, PIECE)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for x, y in _chunks([p for _, p in pieces]):
        for (i, _), picture in zip(pieces[x:y], encode_batch([p for _, p in pieces[x:y]]), strict=True):
            out[i].append(picture)
    return [b"".join(o) for o in out]


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + b" " * (-len(raw) % unit if raw else unit)


class Feature:
    """Size, channel means and checksum of a tensor that comes in strips."""

    def __init__(self) -> None:
        self.width = self.height = self.check = 0
        self.sums = np.zeros(3, np.int64)

    def add(self, rgb: np.ndarray) -> None:
        self.width, self.height, self.check = rgb.shape[1], self.height + rgb.shape[0], zlib.crc32(rgb.tobytes(), self.check)
        self.sums += rgb.sum(axis=(0, 1), dtype=np.int64)

    def __str__(self) -> str:
        means = ",".join(f"{x / (self.height * self.width):.4f}" for x in self.sums.tolist())
        return f"{self.width}x{self.height};{means};{self.check:08x}"


def _chunks(values: list[bytes]) -> Iterator[tuple[int, int]]:
    """Spans of at most CHUNK bytes, or of one value."""
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)


def _without(df: DataFrame, *names: str) -> list[str]:
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def _mapped(df: DataFrame, kept: list[str], column: str, fields: list[tuple[str, T.DataType]], work: Callable[[list], list[pa.Array]]) -> DataFrame:
    """The ``kept`` columns of ``df`` with those that ``work`` makes of the values of ``column``, some rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [x.encode() if isinstance(x, str) else x or b"" for x in b.column(len(kept)).to_pylist()]
            for x, y in _chunks(values):
                yield pa.RecordBatch.from_arrays([*b.slice(x, y - x).columns[:-1], *work(values[x:y])], names=[*kept, *[n for n, _ in fields]])

    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").alias("_value"))
    return rows.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, k) for n, k in fields]]))


def store_payloads(df: DataFrame, payload_col: str, out_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with each payload's progressive JPEG; the payload is binary or text, null as
    empty."""
    kept = [c for c in _without(df, out_col) if keep is None or c in keep]
    return _mapped(df, kept, payload_col, [(out_col, T.BinaryType())], lambda values: [pa.array(encode_payloads([pad(v) for v in values]), pa.binary())])


def load_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with payload, width, height and rgb (the tensor's bytes, row by row) of each file."""
    fields = [("payload", T.BinaryType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("rgb", T.BinaryType())]

    def work(files: list[bytes]) -> list[pa.Array]:
        got = decode_batch(files)
        return [pa.array([p for p, _ in got], pa.binary()), pa.array([t.shape[1] for _, t in got], pa.int32()), pa.array([t.shape[0] for _, t in got], pa.int32()), pa.array([t.tobytes() for _, t in got], pa.binary())]

    return _mapped(df, _without(df, *[n for n, _ in fields]), media_col, fields, work)


def media_digests(df: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``df``, or its columns ``keep``, with what the bytes of each file read back say: payload_bytes, payload_sha256, tail_crc32 (of the payload's last 16
    bytes), media_bytes, media_sha256, feature (of the tensor)."""
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def work(files: list[bytes]) -> list[pa.Array]:
        sizes, sha, tails, features = [0] * len(files), [hashlib.sha256() for _ in files], [b""] * len(files), [Feature() for _ in files]
        for i, payload, rgb in decoded(files):
            sizes[i] += len(payload)
            sha[i].update(payload)
            tails[i] = (tails[i] + payload[-16:])[-16:]
            features[i].add(rgb)
        return [pa.array(sizes, pa.int64()), pa.array([h.hexdigest() for h in sha]), pa.array([zlib.crc32(t) for t in tails], pa.int64()), pa.array([len(f) for f in files], pa.int64()),
                pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([str(f) for f in features])]

    kept = [c for c in _without(df, *[n for n, _ in fields]) if keep is None or c in keep]
    return _mapped(df, kept, media_col, fields, work)


def op1_media(spark, sf_dir):
    """The texts stored as a column of files, and what is read back from that column."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return media_digests(store_payloads(docs, "text", keep=["doc_id", "n_bytes"]), keep=["doc_id", "n_bytes"])
