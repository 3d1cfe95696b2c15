"""Scalar expressions, all built-in Spark functions so that they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two type tokens of a schema descriptor.
INT64, STRING = "int64", "string"

_BY_TOKEN = {INT64: T.LongType(), STRING: T.StringType()}
_BY_TYPE = {T.LongType: INT64, T.StringType: STRING}
int64_tag_size = 8
#: Leading C white space, an optional sign and decimal digits; whatever follows is ignored.
_LEADING_INT = r"^[ \t\n\x0B\f\r]*([+-]?[0-9]+)"


def token_of(kind: T.DataType) -> str:
    """The descriptor token of a Spark type; ValueError for a type the model lacks."""
    if type(kind) not in _BY_TYPE:
        raise ValueError(f"no type token for {kind.simpleString()}")
    return _BY_TYPE[type(kind)]


def data_type_of(token: str) -> T.DataType:
    """The Spark type of a token, which must match exactly (no case folding, no trimming)."""
    if token not in _BY_TOKEN:
        raise ValueError(f"unknown type token {token!r}")
    return _BY_TOKEN[token]


def parse_int64(text: Column) -> Column:
    """Text to bigint by its leading integer: ' 7' and '12abc' give 7 and 12. No digits, or a value
    beyond 64 bits, raises when the row is evaluated. Null stays null."""
    digits = F.regexp_extract(text, _LEADING_INT, 1)
    bad = F.raise_error(F.concat(F.lit("not an int64: "), text)).cast("bigint")
    return F.when(text.isNull(), F.lit(None).cast("bigint")).when(digits == "", bad).otherwise(digits.cast("bigint"))


def parse_field(text: Column, kind: T.DataType) -> Column:
    """A raw CSV field as its declared type; a missing field is the empty string, never null."""
    raw = F.coalesce(text, F.lit(""))
    return parse_int64(raw) if token_of(kind) == INT64 else raw


def stringify(value: Column) -> Column:
    """Decimal text of an integer; a string is itself."""
    return value.cast("string")


def quote_field(value: Column, quote: str = '"') -> Column:
    """The field in quotes, with each quote inside doubled."""
    q = F.lit(quote)
    return F.concat(q, F.replace(stringify(value), q, F.lit(quote * 2)), q)


def csv_line(*values: Column, delimiter: str = ",", quote: str = '"') -> Column:
    """One CSV record without its line break, every field quoted."""
    return F.concat_ws(delimiter, *[quote_field(v, quote) for v in values])


def stored_size(value: Column, kind: T.DataType) -> Column:
    """Bytes that one value takes in the binary format."""
    return F.lit(int64_tag_size).cast("bigint") if token_of(kind) == INT64 else F.lit(int64_tag_size) + F.octet_length(value).cast("bigint")
