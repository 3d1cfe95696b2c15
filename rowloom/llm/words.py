"""Words of Arrow text columns: split and made distinct in Arrow, so that Python sees each distinct word of a slice once,
and what is known of the words is dealt back to their places by numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one slice has, unless a single row has more.
SLICE_BYTES = 8 << 20
#: New words that are encoded at once.
BLOCK = 1 << 15


def trimmed() -> None:
    """Gives the memory that the allocators hold free back to the system. Workers outlive their tasks, and what they
    hold counts against the next stage of their executor."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches of ``rows`` rows and ``size`` bytes of text in ``column`` at most, one row at least."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield b.slice(at, to - at)
            at = to


def _bytes(texts: pa.StringArray) -> list[bytes]:
    """Values without nulls, cut from the array's buffer."""
    _, ends, data = texts.buffers()
    cuts = np.frombuffer(ends, "<i4", len(texts) + 1, 4 * texts.offset).tolist() if len(texts) else [0]
    raw = data.to_pybytes() if data else b""
    return [raw[x:y] for x, y in zip(cuts, cuts[1:])]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words between ASCII white space; each word's place among these; where each text's words begin,
    and the end. Null is the empty text. ``lower``: A-Z to a-z first, by ASCII alone."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    words = _bytes(coded.dictionary)
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    if b"" in words:  # before leading and after trailing white space
        empty = words.index(b"")
        real = which != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        which = which[real]
        words[empty] = words[-1]
        which[which == len(words) - 1] = empty
        words.pop()
    return words, which, offsets


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i]`` of all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class KnownIds:
    """Token ids of byte strings that were met before. ``encode`` gives the ids of new ones as little-endian unsigned
    32-bit integers; ``keep`` strings or those of one call, whichever is more, stay known. What is known is in Arrow and
    numpy arrays, some tens of bytes a string, as a worker holds it for long; a dict of Python objects is several times that."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], keep: int) -> None:
        self.encode, self.keep = encode, keep
        self.known = pa.array([], pa.binary())
        self.pool, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _forget_but(self, rows: np.ndarray) -> None:
        """Forget all that is not at these places; what is takes their order."""
        self.pool, sizes = self.ids(rows)
        self.known, self.size = self.known.take(pa.array(rows)), self.size[rows]
        self.start = np.cumsum(sizes) - sizes

    def _learn(self, new: pa.BinaryArray) -> None:
        coded = [ids for at in range(0, len(new), BLOCK) for ids in self.encode(_bytes(new.slice(at, BLOCK)))]
        size = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
        self.known = pa.concat_arrays([self.known, new])
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size, dtype=np.int64) - size])
        self.size = np.concatenate([self.size, size])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(coded), "<u4")])

    def rows(self, keys: pa.BinaryArray) -> np.ndarray:
        """The place of each of the keys, which are distinct, among those known now."""
        rows = pc.fill_null(pc.index_in(keys, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = rows < 0
        if n := np.count_nonzero(new):
            if len(self.known) + n > self.keep:  # the words in use stay, as the common ones are among them
                self._forget_but(rows[~new])
                rows[~new] = np.arange(len(rows) - n)
            at = len(self.known)
            self._learn(keys.filter(pa.array(new)))
            rows[new] = np.arange(at, at + n)  # each key once, in their order
        return rows

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places, one after the other, and how many each has."""
        sizes = self.size[rows].astype(np.int64)
        return self.pool[runs(self.start[rows], sizes)], sizes


class WordIds:
    """Token ids of texts whose words are encoded one by one, by :class:`KnownIds`."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], keep: int) -> None:
        self.known = KnownIds(encode, keep)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        words, which, offsets = split_words(texts)
        ids, sizes = self.known.ids(self.known.rows(pa.array(words, pa.binary()))[which])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[offsets[1:]]
