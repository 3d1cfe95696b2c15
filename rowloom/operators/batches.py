"""Batches are rows that share ``batch_id``; columns of a batch are addressed by position.

A table frame has ``row_id`` (0..n-1, the order of the source), ``batch_id`` and the data columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import stored_size, stringify
from rowloom.sources.files import evaluated

#: Fixed value: rows in a batch unless a table says otherwise.
ROWS_PER_BATCH = 100
#: Batches of a span in :func:`batch_metadata`.
BATCH_SPAN = 4096
KEYS = ("row_id", "batch_id")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS]


def _unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``df`` has as columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def file_order(path: str, block: str) -> list[Column]:
    """Folder, part number (of ``part-*`` files), path and block."""
    return [F.regexp_extract(path, "^(.*)/", 1), F.try_to_number(F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1), F.lit("999999999999")), F.col(path), F.col(block)]


def number_file_rows(df: DataFrame) -> DataFrame:
    """Consecutive ``row_id`` for rows read from files, in the order of :func:`file_order` and line. ``df`` carries ``_metadata``. Only per-split counts are ordered globally, never rows; the table of
    splits, a row for each, is broadcast, as else the rows would be shuffled for its sake."""
    path, block, at, part, n, shift = _unused(df, "_path", "_block", "_at", "_part", "_n", "_shift")
    marked = df.select(*[F.col(f"`{c}`") for c in df.columns if c != "_metadata"], F.col("_metadata.file_path").alias(path),
                       F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(at))
    splits = marked.groupBy(path, block).agg(F.count("*").alias(n), F.min(at).alias(at))
    before = Window.orderBy(*file_order(path, block)).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file split
    splits = splits.select(path, block, (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(at)).alias(shift))
    return marked.join(F.broadcast(splits), [path, block]).withColumn("row_id", F.col(at) + F.col(shift)).drop(path, block, at, shift)


def number_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive ``row_id`` in the order of ``keys``: a range sort, then per-partition counts turned into offsets.
    The sorted rows are evaluated once, into a table that has partition and place as columns, and both the counts
    and the rows come from it: another evaluation may draw other bounds and merge other partitions."""
    part, at, n, shift = _unused(df, "_part", "_at", "_n", "_shift")
    ordered = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    placed = ordered.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = evaluated(placed, "numbered")
    counts = placed.groupBy(part).agg(F.count("*").alias(n))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    shifts = counts.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(shift))
    return placed.join(F.broadcast(shifts), part).withColumn("row_id", F.col(at) + F.col(shift)).drop(part, at, shift)


def assign_batches(df: DataFrame, rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    if rows_per_batch < 1:
        raise ValueError("a batch has at least one row")
    return df.withColumn("batch_id", F.floor(F.col("row_id") / F.lit(rows_per_batch)).cast("bigint"))


def empty_batch(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def batch_of_columns(spark: SparkSession, columns: list[list], schema: T.StructType) -> DataFrame:
    """Typed columns to a batch with ``row_id``: as many columns as the schema, all of one length and type."""
    if len(columns) != len(schema.fields):
        raise ValueError("number of columns differs from the schema")
    if len({len(c) for c in columns}) > 1:
        raise ValueError("columns differ in length")
    rows = [(i, *values) for i, values in enumerate(zip(*columns, strict=True))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("row_id", T.LongType(), False), *schema.fields]))


def column_count(df: DataFrame) -> int:
    return len(data_columns(df))


def is_empty(df: DataFrame) -> bool:
    """Without columns; a batch that has columns and no rows is not empty."""
    return column_count(df) == 0


def column_at(df: DataFrame, i: int) -> DataFrame:
    """The i-th data column as ``row_id, value``; the scan reads no other column."""
    return df.select("row_id", F.col(f"`{data_columns(df)[i]}`").alias("value"))


def element_at(df: DataFrame, i: int, row: int) -> DataFrame:
    return column_at(df, i).filter(F.col("row_id") == row).select("value")


def add_column(df: DataFrame, column: DataFrame, name: str) -> DataFrame:
    """Append ``column`` (row_id, value) by position; a length that differs raises when evaluated."""
    missing = F.raise_error(F.lit("columns differ in length"))
    both = df.withColumn("_l", F.lit(True)).join(column.withColumnRenamed("value", name).withColumn("_r", F.lit(True)), "row_id", "full_outer")
    return both.filter(F.when(F.col("_l").isNull() | F.col("_r").isNull(), missing.cast("boolean")).otherwise(F.lit(True))).drop("_l", "_r")


def serialize(df: DataFrame) -> DataFrame:
    """Every data column as text."""
    keys = [c for c in KEYS if c in df.columns]
    return df.select(*keys, *[stringify(F.col(f"`{c}`")).alias(c) for c in data_columns(df)])


def columns_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``equal``: same type, length and elements by position."""
    if a.schema["value"].dataType != b.schema["value"].dataType:
        return a.sparkSession.createDataFrame([(False,)], "equal boolean")
    both = a.select("row_id", F.col("value").alias("_x"), F.lit(1).alias("_a")).join(b.select("row_id", F.col("value").alias("_y"), F.lit(1).alias("_b")), "row_id", "full_outer")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_x").eqNullSafe(F.col("_y"))
    return both.agg(F.coalesce(F.bool_and(same), F.lit(True)).alias("equal"))


def _batch_sizes(df: DataFrame) -> DataFrame:
    """batch_id, rows_cnt, bytes."""
    size = reduce(lambda x, y: x + y, [stored_size(F.col(f"`{c}`"), df.schema[c].dataType) for c in data_columns(df)], F.lit(0).cast("bigint"))
    return df.groupBy("batch_id").agg(F.count("*").alias("rows_cnt"), F.sum(size).alias("bytes"))


def batch_metadata(df: DataFrame) -> DataFrame:
    """For each batch: byte offset in the binary layout, columns, rows and bytes. Offsets are prefix sums in two levels,
    over spans of BATCH_SPAN batches and within each: one task orders one row for each span, never the batches."""
    per = _batch_sizes(df).withColumn("_span", F.floor(F.col("batch_id") / BATCH_SPAN))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    spans = per.groupBy("_span").agg(F.sum("bytes").alias("_all")).select("_span", so_far("_all", Window.orderBy("_span")).alias("_start"))
    placed = per.withColumn("_within", so_far("bytes", Window.partitionBy("_span").orderBy("batch_id"))).join(spans, "_span")
    return placed.select("batch_id", (F.col("_start") + F.col("_within")).alias("offset"), F.lit(len(data_columns(df))).cast("bigint").alias("columns_cnt"), "rows_cnt", "bytes")


def batch_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("batch_id").alias("batches"))


def layout_size(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """Bytes of the table as one binary file: data, footer and the footer's pointer."""
    footer = 8 + sum(16 + len(n.encode()) + len(t.encode()) for n, t in fields) + 8 + 8
    total = _batch_sizes(df).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("data"), F.count("*").alias("batches"))
    return total.select((F.col("data") + F.lit(footer) + F.lit(24) * F.col("batches")).cast("bigint").alias("file_bytes"))
