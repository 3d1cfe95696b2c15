"""The registered queries of the table pipeline and their SQL. Each goes through the stage it names: rows are
written and read back, never taken from the input tables directly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import cli
from rowloom.functions import csv_line, parse_int64
from rowloom.operators import batches as B
from rowloom.plans.pipeline import csv_rows, extract_table, import_csv
from rowloom.plans.schema import column_count, field_at, fields_of, make_schema, of_frame, read_descriptor, same_schema, write_descriptor
from rowloom.sources.csv_files import Dialect, write_ordered_files, write_single_file
from rowloom.sources.exact_csv import read_records
from rowloom.sources.files import work_path, write_text
from rowloom.sources.store import open_table, read_batch, table_schema, write_table

#: Tables within the integer and string model: key for the row order, and columns (name, token).
TABLES = {
    "documents": ("doc_id", [("doc_id", "int64"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int64")]),
    "pages": ("page_id", [("page_id", "int64"), ("url", "string"), ("html", "string")]),
    "conversations": ("conv_id, turn", [("conv_id", "int64"), ("turn", "int64"), ("role", "string"), ("text", "string")]),
    "events": ("event_id", [("event_id", "int64"), ("user_id", "int64"), ("event_type", "string"), ("props", "string")]),
    "orders": ("o_orderkey", [("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "string"), ("o_orderpriority", "string")]),
    "nation": ("n_nationkey", [("n_nationkey", "int64"), ("n_name", "string"), ("n_regionkey", "int64")]),
}


def usable(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, list[str]]:
    """The table's usable columns as int64 and string, nulls as zero and empty, and its key."""
    key, fields = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = {"int64": "bigint", "string": "string"}
    return df.select(*[F.coalesce(F.col(c).cast(kinds[t]), F.lit(0 if t == "int64" else "").cast(kinds[t])).alias(c) for c, t in fields]), key.split(", ")


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """:func:`usable`, numbered in key order."""
    df, keys = usable(spark, sf_dir, name)
    return B.number_by_key(df, keys).select("row_id", *df.columns)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = work_path(spark, name)
    write_table(B.assign_batches(source(spark, sf_dir, name)), path)
    return open_table(spark, path)


def roundtrip(name: str, parts: bool = True, exact: bool = False, dialect: Dialect = Dialect()) -> Callable[[SparkSession, str], DataFrame]:
    """Table to CSV, CSV to table, table to CSV, and that CSV to the rows returned; by ordered part files, or by one
    file."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = make_schema(TABLES[name][1])
        first, table, second = (work_path(spark, f"{name}-{x}") for x in ("a.csv", "table", "b.csv"))
        df, keys = usable(spark, sf_dir, name)
        (write_ordered_files if parts else write_single_file)(df, first, keys, dialect)
        import_csv(spark, schema, first, table, dialect=dialect, exact=exact)
        extract_table(spark, table, second, dialect, parts=parts)
        return csv_rows(spark, schema, second, dialect, exact=exact).drop("batch_id")

    return run


def binary_roundtrip(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from rowloom.sources.binary_file import read_batch_file, write_batch_file

        path = work_path(spark, f"{name}.bin")
        write_batch_file(B.assign_batches(source(spark, sf_dir, name)), path, numbered=True)
        return read_batch_file(spark, path)

    return run


def cli_roundtrip(*flags: str) -> Callable[[SparkSession, str], DataFrame]:
    """The commands: a descriptor and a CSV file to a table, the table to a CSV file, read as it says."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = make_schema(TABLES["events"][1])
        descriptor, first, table, second = (work_path(spark, x) for x in ("schema.csv", "a.csv", "table", "b.csv"))
        write_descriptor(spark, schema, descriptor)
        df, keys = usable(spark, sf_dir, "events")
        write_single_file(df, first, keys)
        if cli.main(["create_table", *flags, descriptor, first, table]) or cli.main(["extract_table", *flags, table, second]):
            raise RuntimeError("a command failed")
        return csv_rows(spark, schema, second).drop("batch_id")

    return run


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one to three fields, by the exact reader: a document's id, then text and source of some."""
    path = work_path(spark, "ragged.csv")
    docs, third = source(spark, sf_dir, "documents"), F.col("doc_id") % 3
    lines = docs.select("row_id", F.when(third == 0, csv_line(F.col("doc_id"))).when(third == 1, csv_line(F.col("doc_id"), F.col("text")))
                        .otherwise(csv_line(F.col("doc_id"), F.col("text"), F.col("source"))).alias("line"))
    lines.repartitionByRange("row_id").sortWithinPartitions("row_id").select("line").write.text(path)
    rows = read_records(spark, path)
    return rows.select("row_id", F.size("fields").alias("width"), *[F.get("fields", F.lit(i)).alias(f"f{i}") for i in range(3)])


def dropped_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a file whose last line has no line break, by both rules for its last field."""
    path = work_path(spark, "open.csv")
    write_text(spark, path, 'a,b\n"x ""y""",,z')
    keep, drop = (read_records(spark, path, final=f).select(F.lit(f).alias("final"), "row_id", F.array_join("fields", "|").alias("fields")) for f in ("keep", "drop"))
    return keep.unionByName(drop)


def batch_ctors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch without columns, one of typed columns, and one of a table's rows, by their counts."""
    schema = make_schema([("k", "int64"), ("v", "string")])
    made = B.batch_of_columns(spark, [[4, 5, 6], ["x", "", "z"]], schema)
    empty = B.empty_batch(spark, make_schema([]))
    rows = read_batch(stored(spark, sf_dir, "nation"), 0)
    out = [(n, B.column_count(b), B.is_empty(b), b.count()) for n, b in (("empty", empty), ("columns", made), ("rows", rows))]
    return spark.createDataFrame(out, "made string, columns bigint, empty boolean, n bigint")


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table_schema(stored(spark, sf_dir, "documents"))
    return spark.createDataFrame([(column_count(s), i, *field_at(s, i)) for i in range(column_count(s))], "n bigint, pos bigint, name string, type string")


def schema_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "schema.csv")
    write_descriptor(spark, make_schema(TABLES["documents"][1]), path)
    rows = [(i, n, t) for i, (n, t) in enumerate(fields_of(read_descriptor(spark, path)))]
    return spark.createDataFrame(rows, "pos bigint, name string, type string")


def schema_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table_schema(stored(spark, sf_dir, n)) for n in ("nation", "orders"))
    declared = make_schema(TABLES["nation"][1])
    return spark.createDataFrame([(same_schema(a, declared), same_schema(a, b), same_schema(a, of_frame(a)))], "same boolean, other boolean, itself boolean")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "orders")
    return t.select("o_orderkey", parse_int64(F.concat(F.lit("  "), F.col("o_orderkey").cast("string"), F.lit("abc"))).alias("parsed"))


def column_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "nation")
    name, region = B.column_at(t, 1), B.column_at(t, 2)
    same = B.columns_equal(name, B.column_at(stored(spark, sf_dir, "nation"), 1)).select(F.col("equal").alias("same"))
    return same.crossJoin(B.columns_equal(region, region.withColumn("value", F.col("value") + 1)).select(F.col("equal").alias("changed")))


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "orders")
    return B.add_column(t, B.column_at(t, 0), "key_again").select("row_id", "o_orderkey", "key_again")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"csv_roundtrip_{n}": roundtrip(n) for n in TABLES}
    return out | {
        "csv_roundtrip_single_file": roundtrip("nation", parts=False),
        "csv_roundtrip_dialect": roundtrip("conversations", dialect=Dialect(";", "'", "|")),
        "csv_roundtrip_exact": roundtrip("pages", exact=True),
        "csv_ragged": ragged,
        "csv_final_field": dropped_field,
        "binary_roundtrip": binary_roundtrip("documents"),
        "binary_roundtrip_nation": binary_roundtrip("nation"),
        "cli_roundtrip": cli_roundtrip(),
        "cli_roundtrip_binary": cli_roundtrip("--binary"),
        "batch_ctors": batch_ctors,
        "schema_fields": schema_fields,
        "schema_descriptor": schema_descriptor,
        "schema_equality": schema_equality,
        "csv_line": _lines,
        "int64_parse": parsed,
        "row_serialize": lambda s, d: B.serialize(stored(s, d, "nation")).drop("batch_id"),
        "batch_assign": lambda s, d: stored(s, d, "documents").select("doc_id", "row_id", "batch_id"),
        "batch_metadata": lambda s, d: B.batch_metadata(stored(s, d, "documents")),
        "batch_count": lambda s, d: B.batch_count(stored(s, d, "orders")),
        "file_layout_size": lambda s, d: B.layout_size(t := stored(s, d, "documents"), fields_of(table_schema(t))),
        "read_batch_n": lambda s, d: read_batch(stored(s, d, "documents"), 3).select("row_id", "doc_id", "text"),
        "read_batch_out_of_range": lambda s, d: read_batch(stored(s, d, "nation"), 10**6).select("row_id", "n_name"),
        "column_project": lambda s, d: B.column_at(stored(s, d, "documents"), 2),
        "element_at": lambda s, d: B.element_at(stored(s, d, "nation"), 1, 7),
        "add_column": added,
        "column_equality": column_equality,
    }


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stored(spark, sf_dir, "documents")
    return t.select("doc_id", csv_line(*[F.col(c) for c in ("doc_id", "text", "lang", "source")]).alias("line"))


def _numbered(name: str) -> str:
    key, fields = TABLES[name]
    cols = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if t == "int64" else c for c, t in fields)
    return f"SELECT row_number() OVER (ORDER BY {key}) - 1 AS row_id, {cols} FROM {name}"


def oracle_sql() -> dict[str, str]:
    docs = f"WITH t AS (SELECT *, row_id // 100 AS batch_id FROM ({_numbered('documents')}))"
    size = "16 + 24 + strlen(text) + strlen(lang) + strlen(source)"
    footer = 8 + sum(16 + len(n) + len(t) for n, t in TABLES["documents"][1]) + 16
    quoted = lambda c: f"""'"' || replace(CAST({c} AS VARCHAR), '"', '""') || '"'"""
    descriptor = ", ".join(f"({i}::BIGINT, '{n}', '{t}')" for i, (n, t) in enumerate(TABLES["documents"][1]))
    return {f"csv_roundtrip_{n}": _numbered(n) for n in TABLES} | {
        "csv_roundtrip_single_file": _numbered("nation"),
        "csv_roundtrip_dialect": _numbered("conversations"),
        "csv_roundtrip_exact": _numbered("pages"),
        "csv_ragged": f"""{docs} SELECT row_id, CAST(doc_id % 3 + 1 AS INT) AS width, CAST(doc_id AS VARCHAR) AS f0, CASE WHEN doc_id % 3 > 0 THEN text END AS f1,
            CASE WHEN doc_id % 3 = 2 THEN source END AS f2 FROM t""",
        "csv_final_field": """SELECT * FROM (VALUES ('keep', 0::BIGINT, 'a|b'), ('keep', 1::BIGINT, 'x "y"||z'), ('drop', 0::BIGINT, 'a|b'), ('drop', 1::BIGINT, 'x "y"|'))
            v("final", row_id, fields)""",
        "binary_roundtrip": f"SELECT *, row_id // 100 AS batch_id FROM ({_numbered('documents')})",
        "binary_roundtrip_nation": f"SELECT *, row_id // 100 AS batch_id FROM ({_numbered('nation')})",
        "cli_roundtrip": _numbered("events"),
        "cli_roundtrip_binary": _numbered("events"),
        "batch_ctors": "SELECT 'empty' AS made, 0::BIGINT AS columns, true AS empty, 0::BIGINT AS n UNION ALL SELECT 'columns', 2, false, 3 UNION ALL SELECT 'rows', 3, false, count(*) FROM nation",
        "schema_fields": f"SELECT {len(TABLES['documents'][1])}::BIGINT AS n, pos, name, type FROM (VALUES {descriptor}) v(pos, name, type)",
        "schema_descriptor": f"SELECT * FROM (VALUES {descriptor}) v(pos, name, type)",
        "schema_equality": "SELECT true AS same, false AS other, true AS itself",
        "csv_line": f"SELECT doc_id, {quoted('doc_id')} || ',' || {quoted('text')} || ',' || {quoted('lang')} || ',' || {quoted('source')} AS line FROM documents",
        "int64_parse": r"SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(regexp_extract('  ' || o_orderkey || 'abc', '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS parsed FROM orders",
        "row_serialize": f"SELECT row_id, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM ({_numbered('nation')})",
        "batch_assign": f"{docs} SELECT doc_id, row_id, batch_id FROM t",
        "batch_metadata": f"""{docs}, b AS (SELECT batch_id, count(*) AS rows_cnt, CAST(sum({size}) AS BIGINT) AS bytes FROM t GROUP BY batch_id)
            SELECT batch_id, CAST(coalesce(sum(bytes) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
            5::BIGINT AS columns_cnt, rows_cnt, bytes FROM b""",
        "batch_count": "SELECT (count(*) + 99) // 100 AS batches FROM orders",
        "file_layout_size": f"{docs} SELECT CAST(sum({size}) + {footer} + 24 * count(DISTINCT batch_id) AS BIGINT) AS file_bytes FROM t",
        "read_batch_n": f"{docs} SELECT row_id, doc_id, text FROM t WHERE batch_id = 3",
        "read_batch_out_of_range": f"SELECT row_id, n_name FROM ({_numbered('nation')}) WHERE false",
        "column_project": f"{docs} SELECT row_id, lang AS value FROM t",
        "element_at": f"SELECT n_name AS value FROM ({_numbered('nation')}) WHERE row_id = 7",
        "add_column": f"SELECT row_id, o_orderkey, o_orderkey AS key_again FROM ({_numbered('orders')})",
        "column_equality": "SELECT true AS same, false AS changed",
    }
