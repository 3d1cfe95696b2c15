"""Records of CSV files that are read in splits, as many tasks as Spark plans for a text file. Files are read by Spark, so
any store it knows will do, and a file has no largest size.

Whether a line begins inside a quoted field hangs on all lines before it. So a first pass says of each split what it
would be either way: whether its end is inside quotes, and how many records begin in it. Those few figures, a row for
each split, are followed in order in one task, which gives each split its state and first record number. A second pass
puts lines together; the pieces of a record that lies in several splits, few by nature, are joined by its number.

A record is the bytes of its lines with their line breaks (none at the end of a file that has none there); for the
built-in parser without the last one, unless a quoted field is left open."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.batches import file_order, number_file_rows
from rowloom.sources.csv_files import STRICT, Dialect, read_text_rows

#: Bytes of records, or records, that a worker returns at once.
BATCH_BYTES, BATCH_RECORDS = 1 << 20, 4096
#: Rows of an Arrow column that are Python objects at once.
LISTED = 256
#: A file of more bytes is read in splits, where the built-in parser would take it in one task.
SPLIT_BYTES = 256 << 20
_BOM = b"\xef\xbb\xbf"
_SPLITS = "split int, path string, block bigint, inside boolean, first bigint, unbroken boolean, marked boolean"


def ends_inside(dialect: Dialect) -> tuple[re.Pattern[bytes], re.Pattern[bytes]]:
    """Patterns of lines (without line break) that end inside a quoted field: those that begin a record, and those that
    begin inside quotes. A quote within a bare field is data."""
    d, q = (re.escape(x.encode()) for x in (dialect.delimiter, dialect.quote))
    no_q, no_d = f"(?:(?!{q.decode()})[\\s\\S])".encode() if len(q) > 2 else b"[^" + q + b"]", f"(?:(?!{d.decode()})[\\s\\S])".encode() if len(d) > 2 else b"[^" + d + b"]"
    held = no_q + b"*+(?:" + q + q + no_q + b"*+)*+"
    fields = b"(?:(?:" + q + held + q + no_d + b"*+|(?!" + q + b")" + no_d + b"*+)" + d + b")*+" + q + held + b"\\Z"
    return re.compile(fields), re.compile(held + b"(?:\\Z|" + q + no_d + b"*+" + d + fields + b")")


def _runs(columns: list[pa.Array], *keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows that have the same keys."""
    changes = np.zeros(len(columns[0]), bool)
    for k in keys:
        changes[1:] |= k[1:] != k[:-1]
    at = [0, *np.flatnonzero(changes).tolist(), len(columns[0])]
    return zip(at[:-1], at[1:], strict=True)


def _listed(lines: pa.Array, lo: int, hi: int) -> Iterator[bytes]:
    """Rows lo to hi, of which few are Python's at once."""
    for at in range(lo, hi, LISTED):
        yield from lines.slice(at, min(LISTED, hi - at)).to_pylist()


def _survey(dialect: Dialect, skip_blank: bool):
    """Of each split: bytes with line breaks, and for a beginning outside and inside quotes, whether the end is inside
    and how many records begin."""
    begun, continued = ends_inside(dialect)
    quote, width = dialect.quote.encode(), len(dialect.linebreak.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int, int], list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            lines, paths, blocks, sizes = b.columns
            codes = paths.dictionary_encode()
            for lo, hi in _runs(b.columns, codes.indices.to_numpy(), blocks.to_numpy()):
                total, a, n, z, m = seen.get(key := (paths[lo].as_py(), blocks[lo].as_py(), sizes[lo].as_py()), (0, False, 0, True, 0))
                for line in _listed(lines, lo, hi):
                    total += len(line) + width
                    kept = not skip_blank or line != b""
                    n += kept and not a
                    m += kept and not z
                    if quote in line:
                        if a == z:
                            a = z = (continued if a else begun).match(line) is not None
                        else:
                            from_begun, from_inside = begun.match(line) is not None, continued.match(line) is not None
                            a, z = (from_inside if a else from_begun), (from_inside if z else from_begun)
                seen[key] = [total, a, n, z, m]
        rows = [dict(zip(("path", "block", "size", "total", "inside_0", "records_0", "inside_1", "records_1"), (*k, *v), strict=True)) for k, v in seen.items()]
        yield from pa.Table.from_pylist(rows, _arrow("path", "block", "size", "total", "inside_0", "records_0", "inside_1", "records_1")).to_batches()

    return run


def _arrow(*names: str) -> pa.Schema:
    kinds = {"path": pa.string(), "split": pa.int32(), "record": pa.binary(), **dict.fromkeys(("inside", "inside_0", "inside_1", "unbroken", "marked"), pa.bool_())}
    return pa.schema([(n, kinds.get(n, pa.int64())) for n in names])


def _follow(width: int):
    """The splits in order, each with its state and the number of its first record; whether it ends its file without line
    break, or begins it with a byte order mark, both of which Spark's text lines lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, out = [x for b in batches for x in b.to_pylist()], []
        inside, first = False, 0
        totals: dict[str, int] = {}
        for x in splits:
            totals[x["path"]] = totals.get(x["path"], 0) + x["total"]
        for n, x in enumerate(splits):
            begins, ends = n == 0 or splits[n - 1]["path"] != x["path"], n + 1 == len(splits) or splits[n + 1]["path"] != x["path"]
            over, inside = totals[x["path"]] - x["size"], inside and not begins
            both = over == width - len(_BOM) != 0
            out.append({"split": n, "path": x["path"], "block": x["block"], "inside": inside, "first": first, "unbroken": ends and (over == width or both), "marked": begins and (over == -len(_BOM) or both)})
            first += x["records_1" if inside else "records_0"]
            inside = x["inside_1" if inside else "inside_0"]
        yield from pa.Table.from_pylist(out, _arrow("split", "path", "block", "inside", "first", "unbroken", "marked")).to_batches()

    return run


def _assemble(dialect: Dialect, skip_blank: bool, whole: bool, raw: bool):
    """Records that lie in one split (``whole``), or the pieces of those that don't."""
    begun, continued = ends_inside(dialect)
    quote, end = dialect.quote.encode(), dialect.linebreak.encode()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        split, inside, number, piece, unbroken, held = None, False, 0, False, False, []

        def finished() -> Iterator[tuple[int, int, bytes]]:
            """What is held, if it is of the kind that is wanted."""
            if held and piece != whole:
                yield number, split, b"".join(held)

        def last() -> Iterator[tuple[int, int, bytes]]:
            """What is held at the end of a split."""
            nonlocal piece
            if held and unbroken and (raw or inside):
                held[-1] = held[-1][: -len(end)]
            piece = piece or inside
            return finished()

        for b in batches:
            if not b.num_rows:
                continue
            lines, splits, starts, firsts, ends, marked = b.columns
            for lo, hi in _runs(b.columns, splits.to_numpy()):
                fresh = splits[lo].as_py() != split
                if fresh:
                    yield from last()
                    split, inside, unbroken, held = splits[lo].as_py(), starts[lo].as_py(), ends[lo].as_py(), []
                    number, piece = firsts[lo].as_py() - 1, inside
                for line in _listed(lines, lo, hi):
                    bom, fresh = _BOM if fresh and raw and marked[lo].as_py() else b"", False
                    if not inside:
                        if skip_blank and not line:
                            continue
                        yield from finished()
                        held, piece, number = [], False, number + 1
                        inside = quote in line and begun.match(line) is not None
                    elif quote in line:
                        inside = continued.match(line) is not None
                    held.append(bom + line + (end if raw or inside else b""))
        yield from last()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, kinds = [], 0, _arrow("row_id", "split", "record")

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

        for x in pieces(batches):
            rows.append(x)
            size += len(x[2])
            if size >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return run


def read_raw_records(spark: SparkSession, path: str, dialect: Dialect = Dialect(), skip_blank: bool = False, raw: bool = True) -> DataFrame:
    """``row_id`` and ``record`` (binary) of each record, numbered in the order of :func:`file_order` and lines.
    ``skip_blank``: empty lines outside quotes are no records. ``raw``: with a byte order mark and the line break at the end."""
    text = spark.read.option("lineSep", dialect.linebreak).text(path)
    lines = text.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    counts = "total bigint, inside_0 boolean, records_0 bigint, inside_1 boolean, records_1 bigint"
    splits = lines.mapInArrow(_survey(dialect, skip_blank), f"path string, block bigint, size bigint, {counts}")
    splits = splits.repartition(1).sortWithinPartitions(*file_order("path", "block")).mapInArrow(_follow(len(dialect.linebreak.encode())), _SPLITS)
    known = lines.drop("size").join(F.broadcast(splits), ["path", "block"]).select("line", "split", "inside", "first", "unbroken", "marked")
    whole, parts = (known.mapInArrow(_assemble(dialect, skip_blank, w, raw), "row_id bigint, split int, record binary") for w in (True, False))
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("split", "record"))), F.lit(bytearray()).cast("binary"), lambda a, x: F.concat(a, x["record"]))
    return whole.select("row_id", "record").unionAll(parts.groupBy("row_id").agg(joined.alias("record")))


def read_numbered_rows(spark: SparkSession, path: str, width: int, dialect: Dialect = Dialect(), multi_line: bool = True) -> DataFrame:
    """``row_id`` and :func:`read_text_rows`, by the same parser: a task a file, or where one has over SPLIT_BYTES, record
    by record from splits. Only the sizes of the files are looked up before an action."""
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] if multi_line else 0
    if (longest or 0) <= SPLIT_BYTES:
        return number_file_rows(read_text_rows(spark, path, width, dialect, multi_line))
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in (dialect.options() | STRICT | {"multiLine": True}).items()}
    names = [f"_c{i}" for i in range(width)]
    fields = F.from_csv(F.col("record").cast("string"), ", ".join(f"{c} string" for c in names), options)
    rows = read_raw_records(spark, path, dialect, skip_blank=True, raw=False).select("row_id", F.inline(F.array(fields)))
    return rows.select("row_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in names])
