"""The table store: a folder of Parquet files in ``row_id`` order. The declared schema travels in the Parquet
footers, so a table of no rows keeps it; a batch is found by Parquet's own statistics on ``batch_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.batches import KEYS, batch_metadata
from rowloom.plans.schema import of_frame
from rowloom.sources.files import exists


def write_table(df: DataFrame, path: str, rows_per_group: int | None = None) -> None:
    """Range-sorted by ``row_id``, so that each file and row group covers a narrow span of batches.
    ``rows_per_group`` fixes the rows of a Parquet row group, to make it equal a batch; unset, Parquet decides."""
    writer = df.repartitionByRange(F.col("row_id")).sortWithinPartitions("row_id").write.mode("overwrite")
    (writer.option("parquet.block.row.count.limit", rows_per_group) if rows_per_group else writer).parquet(path)


def open_table(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def table_schema(table: DataFrame) -> T.StructType:
    return of_frame(T.StructType([f for f in table.schema.fields if f.name not in KEYS]))


def read_batch(table: DataFrame, n: int) -> DataFrame:
    """The n-th batch, without rows if there is none; the filter reaches the Parquet scan."""
    return table.filter(F.col("batch_id") == F.lit(n).cast("bigint"))


def table_metadata(table: DataFrame) -> DataFrame:
    return batch_metadata(table)
