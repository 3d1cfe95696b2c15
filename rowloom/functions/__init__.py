"""Scalar expressions: type tokens, integer parsing, stringification, CSV quoting."""
from .scalars import (INT64, STRING, csv_line, data_type_of, int64_tag_size, parse_field, parse_int64, quote_field, stored_size,
                      stringify, token_of)

__all__ = ["INT64", "STRING", "csv_line", "data_type_of", "int64_tag_size", "parse_field", "parse_int64", "quote_field",
           "stored_size", "stringify", "token_of"]
