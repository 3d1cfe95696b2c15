"""``batch_file``: the interchange binary file. Layout: for each batch the values of column 0, then of column 1
and so on; an integer is 8 bytes, a string an 8-byte length and its bytes, little-endian; then a footer with the
schema, the number of batches and (offset, columns, rows) of each; the last 8 bytes point at the footer.

Reading plans a partition for each run of batches of PARTITION_BYTES or more and prunes them by a filter on
``batch_id`` (``spark.sql.python.filterPushdown.enabled``). Writing takes partitions of whole batches, sorted by
``row_id``; each task writes a part beside the file, and the commit strings them together in blocks. Options: path, rows_per_batch, strings (``binary``: text as bytes that needn't be UTF-8, which is
refused otherwise). Files are local or mounted, and the driver sees them."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from rowloom.functions import INT64, STRING
from rowloom.operators.batches import ROWS_PER_BATCH, assign_batches, number_by_key
from rowloom.plans.schema import fields_of, flat, make_schema

#: Data of the batches that one partition reads.
PARTITION_BYTES = 32 << 20
#: Bytes that the commit of a written file copies at once.
COPY_BYTES = 8 << 20
_INT = struct.Struct("<q")
_SPAN = struct.Struct("<qqq")


@dataclass
class Footer:
    fields: list[tuple[str, str]]
    batches: list[tuple[int, int, int]]  # offset, columns, rows


def encode_text(value: str) -> bytes:
    raw = value.encode()
    return _INT.pack(len(raw)) + raw


def encode_column(values: list, token: str) -> bytes:
    return b"".join(map(_INT.pack, values)) if token == INT64 else b"".join(map(encode_text, values))


def encode_fields(fields: list[tuple[str, str]]) -> bytes:
    return b"".join(_INT.pack(x) if isinstance(x, int) else encode_text(x) for x in flat(make_schema(fields)))


def encode_footer(footer: Footer, at: int) -> bytes:
    return encode_fields(footer.fields) + _INT.pack(len(footer.batches)) + b"".join(_SPAN.pack(*b) for b in footer.batches) + _INT.pack(at)


def read_footer(path: str) -> Footer:
    with open(path, "rb") as f:
        f.seek(0, os.SEEK_END)
        if (size := f.tell()) < 8:
            raise ValueError(f"{path} is no batch file")
        f.seek(size - 8)
        f.seek(_INT.unpack(f.read(8))[0])
        raw = memoryview(f.read())
    at = 0

    def number() -> int:
        nonlocal at
        at += 8
        return _INT.unpack_from(raw, at - 8)[0]

    def text() -> str:
        nonlocal at
        n = number()
        at += n
        return bytes(raw[at - n : at]).decode()

    fields = [(text(), text()) for _ in range(number())]
    return Footer(fields, [(number(), number(), number()) for _ in range(number())])


def local_path(path: str) -> str:
    """The path for Python's file calls; ValueError for a store that they can't open."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{path}: binary files are on local or mounted paths")
    return "/" + rest.lstrip("/") if scheme else path


def decode_columns(raw: memoryview, tokens: list[str], rows: int, as_bytes: bool = False) -> list[list]:
    """The values of a batch's columns."""
    at, out = 0, []
    for token in tokens:
        if token == INT64:
            out.append(list(struct.unpack_from(f"<{rows}q", raw, at)))
            at += 8 * rows
            continue
        column = []
        for _ in range(rows):
            n_bytes = _INT.unpack_from(raw, at)[0]
            value = bytes(raw[at + 8 : at + 8 + n_bytes])
            column.append(value if as_bytes else value.decode())
            at += 8 + n_bytes
        out.append(column)
    return out


@dataclass
class BatchRun(InputPartition):
    """Consecutive batches: ordinal, first row, offset, end (None: of the file), columns and rows of each."""

    spans: list[tuple[int, int, int, int | None, int, int]]


class BatchFileReader(DataSourceReader):
    def __init__(self, path: str, as_bytes: bool) -> None:
        self.path, self.as_bytes, self.only = path, as_bytes, None
        self.fields = read_footer(path).fields

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("batch_id",):
                self.only = f.value if self.only in (None, f.value) else -1
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        batches, first = read_footer(self.path).batches, 0
        runs: list[list[tuple]] = []
        for n, (offset, width, rows) in enumerate(batches):
            end = batches[n + 1][0] if n + 1 < len(batches) else None
            if self.only in (None, n):
                if not runs or offset - runs[-1][0][2] >= PARTITION_BYTES:
                    runs.append([])
                runs[-1].append((n, first, offset, end, width, rows))
            first += rows
        return [BatchRun(r) for r in runs] or [BatchRun([])]

    def read(self, partition: BatchRun) -> Iterator[pa.RecordBatch]:
        fields = self.fields
        kinds = [pa.int64() if token == INT64 else pa.binary() if self.as_bytes else pa.string() for _, token in fields]
        names = ["row_id", "batch_id", *[f.name for f in make_schema(fields).fields]]
        with open(self.path, "rb") as f:
            for n, first, offset, end, width, rows in partition.spans:
                f.seek(offset)
                raw = memoryview(f.read() if end is None else f.read(end - offset))
                columns = decode_columns(raw, [token for _, token in fields[:width]], rows, self.as_bytes)
                arrays = [pa.array(columns[i] if i < len(columns) else [None] * rows, kind) for i, kind in enumerate(kinds)]
                keys = [pa.array(range(first, first + rows), pa.int64()), pa.array([n] * rows, pa.int64())]
                yield pa.RecordBatch.from_arrays([*keys, *arrays], names)


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: file, first row, rows, bytes and batches. The batches' spans are in a file beside it."""

    file: str
    first: int
    rows: int
    size: int
    batches: int


class BatchFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, rows_per_batch: int) -> None:
        if "row_id" not in schema.names:
            raise ValueError("a batch file is written from rows with row_id")
        self.path, self.rows, self.folder = path, rows_per_batch, f"{path}.writing"
        self.fields = fields_of(StructType([f for f in schema.fields if f.name != "row_id"]))
        self.names = [f.name for f in schema.fields if f.name != "row_id"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        part, held = Part(f"{self.folder}/{uuid.uuid4().hex}", 0, 0, 0, 0), None
        with open(part.file, "wb") as f, open(f"{part.file}.spans", "wb") as spans:

            def put(rows: pa.Table) -> None:
                body = b"".join(encode_column(rows.column(name).to_pylist(), token) for name, (_, token) in zip(self.names, self.fields, strict=True))
                f.write(body)
                spans.write(_SPAN.pack(part.size, len(self.fields), rows.num_rows))
                part.size += len(body)
                part.batches += 1

            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(batch.schema.get_field_index("row_id")).to_numpy()
                if not part.rows:
                    part.first = int(ids[0])
                if part.first % self.rows or not np.array_equal(ids, np.arange(part.first + part.rows, part.first + part.rows + len(ids))):
                    raise ValueError("a partition needs whole batches of consecutive row_id")
                part.rows += len(ids)
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
                while held.num_rows >= self.rows:
                    put(held.slice(0, self.rows))
                    held = held.slice(self.rows)
            if held is not None and held.num_rows:
                put(held)
        return part

    def commit(self, messages) -> None:
        """The parts in the order of their rows, then the footer, in a new file that takes the target's place. Memory
        is one block and one part's spans."""
        os.makedirs(self.folder, exist_ok=True)
        parts, first, at = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.first), 0, 0
        for n, part in enumerate(parts):
            if part.first != first or n + 1 < len(parts) and part.rows % self.rows:
                raise ValueError("row_id is not 0..n-1, or a batch lies in two partitions")
            first += part.rows
        with open(f"{self.folder}/whole", "wb") as out:
            for part in parts:
                with open(part.file, "rb") as f:
                    shutil.copyfileobj(f, out, COPY_BYTES)
                os.remove(part.file)
            out.write(encode_fields(self.fields) + _INT.pack(sum(p.batches for p in parts)))
            for part in parts:
                spans = np.fromfile(f"{part.file}.spans", "<i8").reshape(-1, 3)
                spans[:, 0] += at
                out.write(spans.tobytes())
                at += part.size
            out.write(_INT.pack(at))
        os.replace(f"{self.folder}/whole", self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class BatchFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "batch_file"

    @property
    def as_bytes(self) -> bool:
        return self.options.get("strings") == "binary"

    def schema(self) -> StructType:
        keys = [StructField("row_id", LongType()), StructField("batch_id", LongType())]
        fields = make_schema(read_footer(local_path(self.options["path"])).fields).fields
        kind = lambda f: BinaryType() if self.as_bytes and f.dataType == StringType() else f.dataType
        return StructType([*keys, *[StructField(f.name, kind(f), True, f.metadata) for f in fields]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchFileReader(local_path(self.options["path"]), self.as_bytes)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BatchFileWriter(local_path(self.options["path"]), schema, int(self.options.get("rows_per_batch", ROWS_PER_BATCH)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BatchFile)


def write_batch_file(table: DataFrame, path: str, rows_per_batch: int = ROWS_PER_BATCH, numbered: bool = False) -> None:
    """A table frame to one binary file, in ``row_id`` order, by as many tasks as its size asks for. Rows are numbered
    anew unless they are known to be ``numbered`` 0..n-1."""
    register(table.sparkSession)
    rows = table.drop("batch_id")
    rows = assign_batches(rows if numbered else number_by_key(rows, ["row_id"]), rows_per_batch)
    rows = rows.repartitionByRange("batch_id").sortWithinPartitions("row_id").drop("batch_id")
    rows.write.format("batch_file").mode("overwrite").options(path=path, rows_per_batch=rows_per_batch).save()


def read_batch_file(spark: SparkSession, path: str, strings: str = "text") -> DataFrame:
    register(spark)
    return spark.read.format("batch_file").options(path=path, strings=strings).load()


__all__ = ["STRING", "Footer", "decode_columns", "encode_footer", "read_batch_file", "read_footer", "register", "write_batch_file"]
