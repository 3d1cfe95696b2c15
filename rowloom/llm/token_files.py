"""Token files of directly addressable codes.

An id is cut into chunks of fixed widths, lowest first. Level 0 holds the first chunk of every id, level 1 the second
chunk of the ids that need one, and so on. Beside each level but the last stands a bitmap, with a bit for each of its
chunks that says whether the id goes on, and a rank directory: the number of set bits before each block of 512. The
place of an id's next chunk is the rank of its bit, so any id is read by one look a level, without decoding others, and
the ids of a document by one run a level. Documents are read back that way.

A file: magic, version, number of documents, tokens and levels; for each level its width, chunks, and byte lengths of
its parts; then the ids of the documents and their cumulative token counts as 64-bit integers, then the levels, each
chunks, bitmap and directory. All integers are little-endian.

Files are written in the order of document ids: the documents are range-sorted by id, each task cuts its sorted rows
into files of bounded size, and a table in the shared folder holds the files as binary values, ordered by
(part, file). That works in any store Spark writes to; :func:`export_files` gives plain files for local use.

Cases: null is the empty text, which has the end id alone. Rows that repeat an id stand one after the other, ordered
by the text's hash; null ids come first. No rows give a table without files. Other columns are not read."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.bpe import CACHE_PIECES, CACHE_WORDS, SLICE_ROWS, plain_pieces, vocabulary_path
from rowloom.llm.common import table, written
from rowloom.llm.words import WordIds, slices

MAGIC, VERSION = b"DACT", 1
WIDTHS = (8, 8, 16)
END_ID = 1
#: A file is closed when it has so many tokens.
FILE_TOKENS = 1 << 20
BLOCK = 512
_HEAD, _LEVEL = struct.Struct("<4sIQQI"), struct.Struct("<IQQQQ")
_NULL_ID = -(1 << 63)


class DacFile:
    """A parsed file: views of its bytes, nothing decoded."""

    def __init__(self, raw: bytes) -> None:
        magic, version, self.n_docs, self.n_tokens, n_levels = _HEAD.unpack_from(raw, 0)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        at = _HEAD.size
        heads = []
        for _ in range(n_levels):
            heads.append(_LEVEL.unpack_from(raw, at))
            at += _LEVEL.size

        def take(kind: str, n_bytes: int) -> np.ndarray:
            nonlocal at
            at += n_bytes
            return np.frombuffer(raw, kind, n_bytes // np.dtype(kind).itemsize, at - n_bytes)

        self.doc_ids, self.ends = take("<i8", 8 * self.n_docs), take("<i8", 8 * self.n_docs)
        self.levels = [(width, take(f"<u{width // 8}", a), take("u1", b), take("<u4", c)) for width, _, a, b, c in heads]

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i`` of a level's bitmap: by the directory, and within the block."""
        i, (_, _, bits, ranks) = int(i), self.levels[level]
        if i == len(self.levels[level][1]):
            return len(self.levels[level + 1][1])
        first = i // BLOCK
        block = int.from_bytes(bits[first * BLOCK // 8 : (i >> 3) + 1].tobytes(), "little")
        return int(ranks[first]) + (block & ((1 << (i - first * BLOCK)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        """Token ``i`` of the file."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for n, (width, chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            shift += width
            if not len(bits) or not bits[i >> 3] >> (i & 7) & 1:
                return value
            i = self._rank(n, i)
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start .. end``, from these places of the levels alone: the next chunks of a run of ids are a run of
        the next level, between the ranks of its ends."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        out = np.zeros(end - start, "<u4")
        at, shift = None, 0
        for n, (width, chunks, bits, _) in enumerate(self.levels):
            part = chunks[start:end].astype("<u4") << np.uint32(shift)
            if at is None:
                out[:] = part
            else:
                out[at] |= part
            if start == end or not len(bits):
                break
            more = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start]
            goes_on = np.flatnonzero(more)
            at = goes_on if at is None else at[goes_on]
            start = self._rank(n, start)
            end, shift = start + len(goes_on), shift + width
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, without those before it."""
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def encode_file(doc_ids: list[int | None], sizes: np.ndarray, tokens: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """Documents, of ``sizes`` tokens each, to a file. The widths, in bits, are 8, 16 or 32 each, and together hold
    every id."""
    rest, ends = tokens.astype(np.uint64), np.cumsum(sizes, dtype="<i8")
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id needs more than all levels")
    heads, parts, total = [], [], len(rest)
    for n, width in enumerate(widths):
        chunks = (rest & np.uint64((1 << width) - 1)).astype(f"<u{width // 8}")
        rest = rest >> np.uint64(width)
        more = rest > 0
        if n + 1 == len(widths) or not more.any():
            bits, ranks = np.zeros(0, "u1"), np.zeros(0, "<u4")
        else:
            bits = np.packbits(more, bitorder="little")
            counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64)
            ranks = (np.cumsum(counts) - counts).astype("<u4")
        heads.append(_LEVEL.pack(width, len(chunks), chunks.nbytes, bits.nbytes, ranks.nbytes))
        parts += [chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
        if not len(bits):
            break
        rest = rest[more]
    ids = np.array([_NULL_ID if i is None else i for i in doc_ids], "<i8")
    return b"".join([_HEAD.pack(MAGIC, VERSION, len(doc_ids), total, len(heads)), *heads, ids.tobytes(), ends.tobytes(), *parts])


class LibraryEncoder:
    """The tokenizers library's ids of whole texts. The library is asked for a piece once, as long as it is kept: its
    normalisation and splitting never look across ASCII white space, and pieces are encoded one by one. Pieces of plain
    words (:func:`rowloom.llm.bpe.plain_pieces`) go to it many at a time with spaces between, and the tokens that end a
    piece tell its ids from the next one's; a word that is not plain, or may hold a special token, goes whole."""

    def __init__(self, path: str, keep_words: int = CACHE_WORDS, keep_pieces: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer

        self.library, self.keep = Tokenizer.from_file(path), keep_pieces
        suffix = json.load(open(path, encoding="utf-8"))["model"]["end_of_word_suffix"]
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.words = WordIds(self.ids_of_words, keep_words)

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        plans = [plain_pieces(w) if b"<" not in w else None for w in words]
        pieces = {p for plan in plans if plan for p in plan}
        if len(self.known) > self.keep:  # those in use stay
            self.known = {p: self.known[p] for p in pieces.intersection(self.known)}
        known = self.known
        new = list(pieces.difference(known))
        groups = [new[at : at + 64] for at in range(0, len(new), 64)]
        for group, ids in zip(groups, self._asked([b" ".join(g) for g in groups]), strict=True):
            cuts = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(cuts) != len(group) + 1:
                raise ValueError("the library parts a piece")
            raw = ids.tobytes()
            known.update(zip(group, [raw[x:y] for x, y in zip(cuts, cuts[1:])], strict=True))
        whole = iter(self._asked([w for w, plan in zip(words, plans, strict=True) if plan is None]))
        return [next(whole).tobytes() if p is None else known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p]) for p in plans]

    def _asked(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 1000):
            for e in self.library.encode_batch_fast([t.decode() for t in texts[at : at + 1000]], add_special_tokens=False):
                yield np.array(e.ids, "<u4")


_loaded: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """The worker's own encoder. Its threads stay off: the tasks of an executor are the parallelism."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = LibraryEncoder(path)
    return _loaded[path]


def token_files(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """The written table of files: part, file, first_id, n_docs, n_tokens, data."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, n = library_encoder(path).words, TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # sizes of documents and their tokens
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, held, size, n
            data = encode_file(ids, np.concatenate([s for s, _ in held]), np.concatenate([t for _, t in held]))
            rows = [{"part": part, "file": n, "first_id": ids[0], "n_docs": len(ids), "n_tokens": size, "data": data}]
            ids, held, size, n = [], [], 0, n + 1
            return pa.RecordBatch.from_pylist(rows, kinds)

        for b in slices(batches, 1, SLICE_ROWS):
            tokens, ends = words(b.column(1))
            keys, sizes = b.column(0).to_pylist(), np.diff(ends, prepend=0) + 1
            with_end = np.full(len(tokens) + len(sizes), end_id, "<u4")
            with_end[np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = tokens
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                before = int(ends[at - 1]) if at else 0
                to = min(len(sizes), int(np.searchsorted(ends, before + file_tokens - size)) + 1)  # the document that fills the file
                ids += keys[at:to]
                held.append((sizes[at:to], with_end[before : ends[to - 1]]))
                size += int(ends[to - 1]) - before
                at = to
                if size >= file_tokens:
                    yield close()
        if ids:
            yield close()

    kinds = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    sorted_rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    files = sorted_rows.mapInArrow(run, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("first_id", "n_docs", "n_tokens")],
                                                      T.StructField("data", T.BinaryType())]))
    return written(files, "token-files")


def read_documents(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document of the files, from their bytes: id, start (tokens of all before it), n_tokens, ids_crc32. Starts
    are sums of the files' token counts, a few numbers a file, taken within a part and over parts."""
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each part
    starts = files.select("part", "file", within.alias("within")).join(parts.select("part", before.alias("before")), "part").select("part", "file", (F.col("within") + F.col("before")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file, raw in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                f = DacFile(raw)
                cuts = np.concatenate([[0], f.ends]).tolist()
                ids = [None if i == _NULL_ID else i for i in f.doc_ids.tolist()]
                crc = [zlib.crc32(f.span(x, y)) for x, y in zip(cuts, cuts[1:])]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(cuts[:-1], pa.int64()),
                                                  pa.array(np.diff(cuts), pa.int64()), pa.array(crc, pa.int64())], names=["part", "file", id_col, "at", "n_tokens", "ids_crc32"])

    documents = files.select("part", "file", "data").mapInArrow(run, f"part int, file int, `{id_col}` bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return documents.join(starts, ["part", "file"]).select(id_col, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> None:
    """Plain ``part-file.dac`` files in a folder that every executor mounts."""

    def save(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(f"{folder}/{r.part:06d}-{r.file:06d}.dac", "wb") as f:
                f.write(r.data)

    files.foreachPartition(save)


def op4_token_files(spark, sf_dir):
    return read_documents(token_files(table(spark, sf_dir, "documents")))
