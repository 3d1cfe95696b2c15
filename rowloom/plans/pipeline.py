"""CSV file to table, and table to CSV file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import parse_field
from rowloom.operators.batches import KEYS, ROWS_PER_BATCH, assign_batches
from rowloom.plans.schema import read_descriptor
from rowloom.sources.csv_files import Dialect, write_ordered_files, write_single_file
from rowloom.sources.split_csv import read_numbered_rows
from rowloom.sources.store import open_table, write_table


def typed_rows(raw: DataFrame, schema: T.StructType, rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """Text fields ``_c*`` with ``row_id`` to typed columns with batch ids."""
    cols = [parse_field(F.col(f"_c{i}"), f.dataType).alias(f.name, metadata=f.metadata or {}) for i, f in enumerate(schema.fields)]
    return assign_batches(raw, rows_per_batch).select("row_id", "batch_id", *cols)


def csv_rows(spark: SparkSession, schema: T.StructType, csv_path: str, dialect: Dialect = Dialect(), rows_per_batch: int = ROWS_PER_BATCH, multi_line: bool = True,
             exact: bool = False, final: str = "keep") -> DataFrame:
    """A CSV file, or a folder of part files in their order, as typed rows with row and batch ids. ``exact`` reads by
    the exact tokenizer, which alone knows ``final='drop'``: the last field of a file without final line break is
    not taken."""
    if any(f.name in KEYS for f in schema.fields):
        raise ValueError(f"a column can't be named {' or '.join(KEYS)}")
    if final != "keep" and not exact:
        raise ValueError("only the exact tokenizer can drop a last field")
    if exact:
        from rowloom.sources.exact_csv import read_fixed_width

        rows = read_fixed_width(spark, csv_path, len(schema.fields), dialect, final)
    else:
        rows = read_numbered_rows(spark, csv_path, len(schema.fields), dialect, multi_line)
    return typed_rows(rows, schema, rows_per_batch)


def import_csv(spark: SparkSession, schema: T.StructType, csv_path: str, table_path: str, *, rows_per_batch: int = ROWS_PER_BATCH, row_groups_as_batches: bool = False, **how) -> None:
    """:func:`csv_rows` to a table. Nothing is committed if a record is malformed."""
    write_table(csv_rows(spark, schema, csv_path, rows_per_batch=rows_per_batch, **how), table_path, rows_per_batch if row_groups_as_batches else None)


def create_table(spark: SparkSession, schema_path: str, csv_path: str, table_path: str, *, binary: bool = False, rows_per_batch: int = ROWS_PER_BATCH, **how) -> None:
    """CSV to a Parquet table, or to one interchange binary file."""
    schema = read_descriptor(spark, schema_path)
    if binary:
        from rowloom.sources.binary_file import write_batch_file

        write_batch_file(csv_rows(spark, schema, csv_path, **how), table_path, rows_per_batch, numbered=True)
    else:
        import_csv(spark, schema, csv_path, table_path, rows_per_batch=rows_per_batch, **how)


def extract_table(spark: SparkSession, table_path: str, csv_path: str, dialect: Dialect = Dialect(), *, binary: bool = False, parts: bool = False) -> None:
    """A table (``binary``: an interchange file) to one CSV file, or with ``parts`` to a folder of ordered part
    files. The table is opened first: if it is missing, an existing target stays as it is."""
    if binary:
        from rowloom.sources.binary_file import read_batch_file

        table = read_batch_file(spark, table_path)
    else:
        table = open_table(spark, table_path)
    (write_ordered_files if parts else write_single_file)(table.drop("batch_id"), csv_path, "row_id", dialect)
