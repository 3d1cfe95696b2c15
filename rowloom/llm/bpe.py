"""BPE encoding and decoding by a pair occurrence index.

The pieces of the new words of a slice of the partition, BLOCK words at once, are laid out as one array of symbols. Each mergeable pair's rank
maps to all its positions in that array; a heap holds the active ranks. The lowest rank is taken, its pair merged at
every position, left to right, and the pairs that arise at the neighbours are put into their lists. Positions whose
pair a merge has taken away stay in their lists until these are taken, and are passed over then. In every piece this is
the order of the merge list, as no merge of the vocabulary makes a pair of a lower rank than its own (checked when the
vocabulary is read).

Words are what stands between ASCII white space: normalisation and splitting of this tokenizer never look across it.
Each distinct word of a slice (SLICE_BYTES of text) is looked up once; a worker keeps the ids of CACHE_WORDS words and
CACHE_PIECES pieces, so that an index holds only what is new, and what it forgets is encoded again.

Normalising and splitting a word with code points from U+0250 on, or controls, is left to the tokenizers library's own normalizer
and pre-tokenizer, whose Unicode tables count; merging never is.

Cases: null is the empty text, without ids, decoded to the empty text. The two special tokens are recognised in raw
text, as the library does. Lone surrogates can't reach Spark strings. Repeated rows are encoded alike. No rows give no
rows; other columns are kept by :func:`encode_documents`, but one of the output's name, which is replaced, and not read
by the query."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import table
from rowloom.llm.words import KnownIds, WordIds, slices, trimmed

CACHE_WORDS, CACHE_PIECES = 600_000, 300_000
SLICE_ROWS = 4000
VOCABULARY = "word_bpe_49k.json"
#: Below this code point every character is composed already, and the Unicode versions agree.
_PLAIN = 0x250
# Fixed value: how the vocabulary parts words, with its classes of letters and numbers below _PLAIN put in.
_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN) if unicodedata.category(chr(c)).startswith(kind))


_OF_ASCII = re.compile(_PIECES.format(letters="a-z", numbers="0-9", spaces=r"\x00-\x20\x7f").encode())
_OF_LATIN = re.compile(_PIECES.format(letters=_class("L"), numbers=_class("N"), spaces=r"\s\x00-\x20\x7f-\xa0"))
_OTHER = re.compile(f"[^\0-{chr(_PLAIN - 1)}]")


def plain_pieces(word: bytes) -> list[bytes] | None:
    """The pieces of a lower-cased word of characters below _PLAIN; None if it has others, controls or odd spaces."""
    if word.isalpha():  # of ASCII alone, in bytes
        return [word.lower()]
    if word.isascii():
        low = word.lower()
        pieces = _OF_ASCII.findall(low)
        return pieces if b"".join(pieces) == low else None
    text = word.decode().lower()
    if _OTHER.search(text):
        return None
    parts = _OF_LATIN.findall(text)
    return [p.encode() for p in parts] if "".join(parts) == text else None


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairIndex:
    """Merges of a vocabulary, applied to many pieces at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.width = max(vocab.values()) + 2
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault(vocab[a] * self.width + vocab[b], r)
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.made.append(vocab[a + b])
        self.keys = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.keys.tolist()], np.int64)
        self.monotonic = self._monotonic()

    def _monotonic(self) -> bool:
        """No merge makes a pair of lower rank."""
        first: dict[int, int] = {}
        for r, m in enumerate(self.made):
            first[m] = r  # the last way to make m
        return all(first.get(a, -1) < r and first.get(b, -1) < r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)))

    def apply(self, pieces: list[bytes], inner: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Token ids of each piece, as little-endian unsigned 32-bit integers. ``inner`` and ``last`` have the symbol
        of each byte value within a piece and at its end."""
        if not pieces:
            return []
        void = self.width - 1  # stands between pieces, in no pair
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        starts = np.cumsum(sizes + 1) - sizes
        ends = np.cumsum(sizes)
        sym = np.full(len(raw) + len(pieces) + 1, void, np.int64)
        symbols = inner[raw]
        symbols[ends - 1] = last[raw[ends - 1]]
        sym[np.arange(len(raw)) + np.repeat(np.arange(1, len(pieces) + 1), sizes)] = symbols
        flat = sym.tolist()
        key = sym[:-1] * self.width + sym[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        where = np.flatnonzero(self.keys[at] == key)
        found = self.ranks[at[where]]
        order = np.argsort(found, kind="stable")
        found, where = found[order], where[order]
        cuts = np.flatnonzero(np.diff(found)) + 1
        index = {int(r[0]): w.tolist() for r, w in zip(np.split(found, cuts), np.split(where, cuts), strict=True) if len(r)}
        every = list(range(-1, len(flat) + 1))  # the two lists share its numbers
        nxt, prv = every[2:], every[:-2]
        heap = sorted(index)
        rank, width, left, right, made = self.rank, self.width, self.left, self.right, self.made
        while heap:
            r = heapq.heappop(heap)
            a, b, m = left[r], right[r], made[r]
            for i in sorted(index.pop(r)):
                if flat[i] != a:
                    continue
                j = nxt[i]
                if flat[j] != b:
                    continue
                k, h = nxt[j], prv[i]
                flat[i], flat[j] = m, -1
                nxt[i] = k
                prv[k] = i
                x = rank.get(flat[h] * width + m)
                if x is not None:
                    if x not in index:
                        index[x] = [h]
                        heapq.heappush(heap, x)
                    else:
                        index[x].append(h)
                x = rank.get(m * width + flat[k])
                if x is not None:
                    if x not in index:
                        index[x] = [i]
                        heapq.heappush(heap, x)
                    else:
                        index[x].append(i)
        done = np.array(flat, np.int64)
        keep = (done >= 0) & (done != void)
        counts = np.add.reduceat(keep, starts, dtype=np.int64)
        counts[-1] = keep[starts[-1] :].sum()
        data, cuts = done[keep].astype("<u4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
        return [data[x:y] for x, y in zip(cuts, cuts[1:])]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, self.special)).encode()) if self.special else None
        self.text_of = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.text_of[i] = s
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.index = PairIndex(self.vocab, merges)
        if not self.index.monotonic:
            raise ValueError("a merge of this vocabulary makes a pair of a lower rank; the index can't follow its order")
        suffix = model["end_of_word_suffix"] or ""
        self.inner = np.array([self.vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([self.vocab[c + suffix] for c in byte_symbols()], np.int64)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.byte_of = {ord(c): b for b, c in enumerate(byte_symbols())}
        self.words = WordIds(self.ids_of_words, cache_words)
        self.of_special = {t.encode(): i.to_bytes(4, "little") for t, i in self.special.items()}
        self.pieces = KnownIds(self.ids_of_pieces, CACHE_PIECES)
        self.texts = pa.array(self.text_of, pa.string())

    def split(self, word: bytes) -> list[bytes]:
        """A word without special tokens to pieces."""
        if (pieces := plain_pieces(word)) is not None:
            return pieces
        parts = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(word.decode()))
        return [bytes(self.byte_of[ord(c)] for c in p) for p, _ in parts]

    def parted(self, word: bytes) -> list[bytes]:
        """A word to pieces and special tokens; no piece reads like one of these."""
        if b"<|" not in word or self.specials is None:
            return self.split(word)
        plan, at = [], 0
        for m in self.specials.finditer(word):
            plan += [*self.split(word[at : m.start()]), m[0]]
            at = m.end()
        return plan + self.split(word[at:])

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. One index spans the pieces of all these words that aren't known."""
        plans = list(map(self.parted, words))
        counts = np.fromiter(map(len, plans), np.int64, len(plans))
        pieces = pa.array(list(chain.from_iterable(plans)), pa.binary()).dictionary_encode()
        ids, sizes = self.pieces.ids(self.pieces.rows(pieces.dictionary)[pieces.indices.to_numpy(zero_copy_only=False)])
        raw, cuts = ids.tobytes(), [0, *(4 * np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]).tolist()]
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    def ids_of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece or special token."""
        merged = iter(self.index.apply([p for p in pieces if p not in self.of_special], self.inner, self.last))
        return [self.of_special[p] if p in self.of_special else next(merged) for p in pieces]

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[x:y] for x, y in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes | np.ndarray) -> str:
        """Special tokens stay. The vocabulary names no decoder, so token texts are joined by spaces."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return self.decode_all(ids, np.array([len(ids)]))[0].as_py()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids that end at ``ends``."""
        return pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), self.texts.take(pa.array(ids.astype(np.int64)))), " ")


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The worker's own encoder, which keeps its words from task to task."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(df: DataFrame, text_col: str = "text", path: str | None = None, out_col: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each text: binary, little-endian unsigned 32-bit. ``path``: the vocabulary file, at the
    same place on every worker."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in slices(batches, kept, SLICE_ROWS):
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(bpe.encode(b.column(kept)), pa.binary())], names=[*b.schema.names[:kept], out_col])
            trimmed()  # after each slice, as what one leaves free in small parts adds up to some 100 MB

    fields = [f for f in df.schema.fields if f.name.lower() != out_col.lower()]
    kept = len(fields)
    rows = df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text_col}`").alias("_encoded_text"))
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out_col, T.BinaryType())]))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """For each row: id, n_tokens, sha256 of the ids, sha256 of the text decoded from those ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in slices(batches, 1, SLICE_ROWS):
            ids, ends = bpe.words(b.column(1))
            raw, cuts = memoryview(ids.tobytes()), [0, *(4 * ends).tolist()]
            sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cuts, cuts[1:])]
            back = [hashlib.sha256(t.as_buffer()).hexdigest() for t in bpe.decode_all(np.frombuffer(raw, "<u4"), ends)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                                             names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        trimmed()

    schema = T.StructType([df.schema[id_col], *[T.StructField(n, k) for n, k in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))]])
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"))


__all__ = ["PairIndex", "WordBpe", "digests", "encode_documents", "op2_bpe", "vocabulary_path"]
