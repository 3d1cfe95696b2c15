"""CSV by the strict record rules, for the cases in which the built-in parser differs: a blank line is a record with one
empty field, a lone quote in an unquoted field or text after a closing quote is malformed, and doubled quotes collapse
in unquoted fields too. Records may differ in their number of fields.

A field is either quoted (anything, quotes doubled) or bare (no delimiter or line break, quotes doubled, not at its
start), and ends at a delimiter, a line break or the end of the file: one compiled pattern matches field and end.

Files are UTF-8 and read by :mod:`rowloom.sources.split_csv` in splits; only with ``malformed='stop'`` one task
tokenises one file, under 2 GB."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.batches import number_file_rows
from rowloom.sources.csv_files import Dialect
from rowloom.sources.split_csv import read_raw_records

#: Records of an Arrow batch, and bytes of them.
RECORDS, RECORD_BYTES = 4096, 1 << 20


class MalformedRecord(ValueError):
    pass


def field_pattern(dialect: Dialect) -> re.Pattern[str]:
    """Groups: what a quoted field holds, a bare field, what ends it."""
    d, q, n = map(re.escape, (dialect.delimiter, dialect.quote, dialect.linebreak))
    quoted, bare = f"{q}((?:[^{q}]|{q}{q})*+){q}", f"((?:[^{d}{q}{n}](?:[^{d}{q}{n}]|{q}{q})*+)?)"
    return re.compile(f"(?:{quoted}|{bare})({d}|{n}|\\Z)")


def tokenize(text: str, dialect: Dialect = Dialect(), final: str = "keep", malformed: str = "raise") -> Iterator[list[str]]:
    """Records of ``text``. ``final``: ``keep``, a last record without line break is a record; ``drop``, its last field
    is not taken. ``malformed``: ``raise``, or ``stop``, records end before the malformed one."""
    field, quote = field_pattern(dialect).match, dialect.quote
    record: list[str] = []
    at, begun = 0, False
    while at < len(text) or begun:
        if (m := field(text, at)) is None:
            if final == "drop" and _open_ended(text, at, dialect):
                yield record
            elif malformed == "raise":
                raise MalformedRecord(f"at character {at}: {'quoted field without end, or text after its closing quote' if text.startswith(quote, at) else 'quote inside an unquoted field'}")
            return
        quoted, bare, end = m.groups()
        at = m.end()
        if end == "" and final == "drop":
            yield record
            return
        record.append((bare if quoted is None else quoted).replace(quote * 2, quote))
        begun = end == dialect.delimiter
        if not begun:
            yield record
            record = []


def _open_ended(text: str, at: int, dialect: Dialect) -> bool:
    """Whether the field at ``at`` is quoted and has no closing quote."""
    q = re.escape(dialect.quote)
    return re.compile(f"{q}(?:[^{q}]|{q}{q})*+\\Z").match(text, at) is not None


def read_records(spark: SparkSession, path: str, dialect: Dialect = Dialect(), final: str = "keep", malformed: str = "raise") -> DataFrame:
    """``row_id`` and ``fields`` (array of string) of each record, in the order of files and records. With
    ``malformed='stop'`` a file's records end before its first malformed one."""
    if malformed == "stop":
        return _records_before_malformed(spark, path, dialect, final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(records, pa.list_(pa.string()))], names=["row_id", "fields"])

        numbers, records, size = [], [], 0
        for b in batches:
            for number, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = raw.as_py().decode()
                for record in tokenize(text, dialect, final):
                    numbers.append(number)
                    records.append(record)
                size += len(text)
                if size >= RECORD_BYTES or len(records) >= RECORDS:
                    yield batch()
                    numbers, records, size = [], [], 0
        if records:
            yield batch()

    return read_raw_records(spark, path, dialect).mapInArrow(run, "row_id bigint, fields array<string>")


def _records_before_malformed(spark: SparkSession, path: str, dialect: Dialect, final: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(path: str, records: list[list[str]]) -> pa.RecordBatch:
            meta = pa.array([{"file_path": path, "file_block_start": 0}] * len(records), pa.struct([("file_path", pa.string()), ("file_block_start", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(records, pa.list_(pa.string())), meta], names=["fields", "_metadata"])

        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                records = []
                for record in tokenize(raw.as_py().decode(), dialect, final, "stop"):
                    records.append(record)
                    if len(records) == RECORDS:
                        yield batch(path, records)
                        records = []
                if records:
                    yield batch(path, records)

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("content"))
    return number_file_rows(files.mapInArrow(run, "fields array<string>, _metadata struct<file_path: string, file_block_start: bigint>")).select("row_id", "fields")


def read_fixed_width(spark: SparkSession, path: str, width: int, dialect: Dialect = Dialect(), final: str = "keep", malformed: str = "raise") -> DataFrame:
    """``row_id`` and text columns ``_c0.._c{width-1}``; a record of another width raises when it is read."""
    rows = read_records(spark, path, dialect, final, malformed)
    wrong = F.raise_error(F.concat(F.lit("record "), F.col("row_id"), F.lit(" has "), F.size("fields"), F.lit(f" fields, not {width}"))).cast("string")
    return rows.select("row_id", *[F.when(F.size("fields") != width, wrong).otherwise(F.get("fields", F.lit(i))).alias(f"_c{i}") for i in range(width)])
