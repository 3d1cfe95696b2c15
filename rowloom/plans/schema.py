"""Schema descriptors: a headerless CSV of ``name,type`` lines, and the StructType that stands for it.

Names may repeat or be empty, which Spark columns may not; the physical column is then made unique and
the declared name is kept in the field's metadata, which Spark writes into Parquet footers."""

from __future__ import annotations

import csv
import io

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from rowloom.functions import data_type_of, token_of
from rowloom.sources.exact_csv import tokenize

_NAME = "declared_name"


def make_schema(fields: list[tuple[str, str]]) -> T.StructType:
    """(name, token) pairs to a StructType with non-null fields."""
    seen: set[str] = set()
    out = []
    for i, (name, token) in enumerate(fields):
        physical = name
        while physical == "" or physical.lower() in seen:
            physical = f"{physical or 'column'}_{i}"
        seen.add(physical.lower())
        out.append(T.StructField(physical, data_type_of(token), False, {_NAME: name}))
    return T.StructType(out)


def fields_of(schema: T.StructType) -> list[tuple[str, str]]:
    """(declared name, token) in order."""
    return [((f.metadata or {}).get(_NAME, f.name), token_of(f.dataType)) for f in schema.fields]


def column_count(schema: T.StructType) -> int:
    return len(schema.fields)


def field_at(schema: T.StructType, i: int) -> tuple[str, str]:
    return fields_of(schema)[i]


def same_schema(a: T.StructType, b: T.StructType) -> bool:
    """Ordered equality of declared names and types."""
    return fields_of(a) == fields_of(b)


def flat(schema: T.StructType) -> list[int | str]:
    """The footer form: count, then name and token of each field."""
    pairs = fields_of(schema)
    return [len(pairs), *[x for pair in pairs for x in pair]]


def of_frame(frame_schema: T.StructType) -> T.StructType:
    """A data frame's own columns as a table schema."""
    return make_schema([((f.metadata or {}).get(_NAME, f.name), token_of(f.dataType)) for f in frame_schema.fields])


def parse_descriptor(text: str) -> T.StructType:
    """Every line must have exactly two fields, by the exact tokenizer, for which a carriage return is data; no line
    at all is a schema without columns."""
    rows = list(tokenize(text))
    for row in rows:
        if len(row) != 2:
            raise ValueError(f"a schema line needs 2 fields, not {len(row)}: {row}")
    return make_schema([(a, b) for a, b in rows])


def render_descriptor(schema: T.StructType) -> str:
    """The descriptor, quoted where a name needs it so that it reads back the same."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(fields_of(schema))
    return out.getvalue()


def read_descriptor(spark: SparkSession, path: str) -> T.StructType:
    """Read by Spark, so that any store it knows will do; a descriptor is a single small file."""
    rows = spark.read.text(path, wholetext=True).take(1)
    return parse_descriptor(rows[0][0] if rows else "")


def write_descriptor(spark: SparkSession, schema: T.StructType, path: str) -> None:
    from rowloom.sources.files import write_text

    write_text(spark, path, render_descriptor(schema))
