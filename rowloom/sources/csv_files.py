"""CSV in and out under one dialect. Reading keeps every field as text: blanks are empty strings, spaces and
backslashes are data, a carriage return is data, and malformed or ragged records raise.

Known limits of the built-in parser, which :mod:`rowloom.sources.exact_csv` does not have: blank lines are
skipped, and a lone quote inside an unquoted field is taken as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import stringify
from rowloom.sources.files import join_parts

#: Options of the built-in parser, by which malformed records raise.
STRICT = {"mode": "FAILFAST", "unescapedQuoteHandling": "RAISE_ERROR"}


@dataclass(frozen=True)
class Dialect:
    """Three distinct single characters."""

    delimiter: str = ","
    quote: str = '"'
    linebreak: str = "\n"

    def __post_init__(self) -> None:
        marks = (self.delimiter, self.quote, self.linebreak)
        if any(len(m) != 1 for m in marks):
            raise ValueError("delimiter, quote and line break are one character each")
        if len(set(marks)) != 3:
            raise ValueError("delimiter, quote and line break must differ")

    def options(self) -> dict[str, object]:
        return {"sep": self.delimiter, "quote": self.quote, "escape": self.quote, "lineSep": self.linebreak, "header": False, "emptyValue": "",
                "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_text_rows(spark: SparkSession, path: str, width: int, dialect: Dialect = Dialect(), multi_line: bool = True) -> DataFrame:
    """All-string frame ``_c0.._c{width-1}``. ``multi_line`` is for line breaks inside quotes, at one task a file, for
    which :func:`rowloom.sources.split_csv.read_numbered_rows` has several; without it a file is split, for inputs known
    to have none. Lazy: nothing is read until an action."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.options(**dialect.options()).csv(path, schema=schema, multiLine=multi_line, **STRICT)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in raw.columns], "_metadata")


def write_rows(df: DataFrame, path: str, dialect: Dialect = Dialect(), mode: str = "overwrite") -> None:
    """A folder of CSV part files, every field quoted, no header. ``mode='append'`` adds to what is there."""
    df.select(*[stringify(F.col(f"`{c}`")).alias(c) for c in df.columns]).write.mode(mode).options(**dialect.options()).csv(path, quoteAll=True)


def write_ordered_files(df: DataFrame, folder: str, order: str | list[str], dialect: Dialect = Dialect()) -> None:
    """A folder of CSV part files that have the rows in the order of ``order``: a column, which is not written, or a list
    of columns, which are. Ranges of it are in the files' part numbers, sorted within. Read back by folder in the same
    order, one task a file or more."""
    keys = [order] if isinstance(order, str) else order
    by = [F.col(f"`{k}`") for k in keys]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    text = rows.select(*[stringify(F.col(f"`{c}`")).alias(c) for c in df.columns if c != order])
    text.write.mode("overwrite").options(**dialect.options()).csv(folder, quoteAll=True)


def write_single_file(df: DataFrame, target: str, order: str | list[str], dialect: Dialect = Dialect()) -> None:
    """One CSV file in the order of ``order``: :func:`write_ordered_files`, whose part files the driver then strings
    together in blocks."""
    folder = f"{target}.writing"
    write_ordered_files(df, folder, order, dialect)
    join_parts(df.sparkSession, folder, target)
