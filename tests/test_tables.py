import os
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom import cli
from rowloom.functions import data_type_of, parse_int64, token_of
from rowloom.operators import batches as B
from rowloom.plans import schema as S
from rowloom.plans.pipeline import create_table, csv_rows, extract_table, import_csv
from rowloom.sources.binary_file import local_path, read_batch_file, read_footer, write_batch_file
from rowloom.sources.csv_files import Dialect, read_text_rows, write_ordered_files, write_rows, write_single_file
from rowloom.sources.exact_csv import MalformedRecord, read_records, tokenize
from rowloom.sources.store import open_table, read_batch, table_metadata, table_schema


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


def run(spark, tmp_path, schema, text, **how):
    table, out = str(tmp_path / "t"), str(tmp_path / "out.csv")
    create_table(spark, put(tmp_path / "s.csv", schema), put(tmp_path / "d.csv", text), table, **how)
    extract_table(spark, table, out)
    return open_table(spark, table), open(out, newline="").read()


def tasks_that_write(spark, run):
    """Tasks of the last stage that ``run`` starts, where partitions are not merged."""
    group = f"tasks-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return tracker.getStageInfo(max(tracker.getJobInfo(max(tracker.getJobIdsForGroup(group))).stageIds)).numTasks


CASES = {
    "mixed": ("k int64, note string", ['1,plain', '-2,"a, b"', '3,"say ""hi"""'], ['"1","plain"', '"-2","a, b"', '"3","say ""hi"""']),
    "one int": ("v int64", ["5", "-7", "0"], ['"5"', '"-7"', '"0"']),
    "limits": ("v int64", ["9223372036854775807", "-9223372036854775808"], ['"9223372036854775807"', '"-9223372036854775808"']),
    "strings": ("a string, b string", [r"C:\dir\n,ünï 🎉", "' , (x)@y "], [r'"C:\dir\n","ünï 🎉"', '"\' "," (x)@y "']),
    "blanks": ("a string, b string, c string", ["x,,", '"",,z'], ['"x","",""', '"","","z"']),
    "lines": ("a string, b string", ['"two\nlines","t\tab"'], ['"two\nlines","t\tab"']),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("exact", [False, True])
def test_roundtrip(spark, tmp_path, name, exact):
    schema, lines, want = CASES[name]
    _, got = run(spark, tmp_path, schema.replace(", ", "\n").replace(" ", ",") + "\n", "\n".join(lines) + "\n", exact=exact)
    assert got == "\n".join(want) + "\n"


def test_no_rows(spark, tmp_path):
    table, got = run(spark, tmp_path, "id,int64\nname,string\n", "")
    assert got == "" and table.count() == 0 and S.fields_of(table_schema(table)) == [("id", "int64"), ("name", "string")]
    assert B.batch_count(table).collect()[0][0] == 0


@pytest.mark.parametrize("n", [99, 100, 101, 200, 1000])
def test_batches(spark, tmp_path, n):
    table, got = run(spark, tmp_path, "i,int64\nv,string\n", "".join(f"{i},v{i}\n" for i in range(n)))
    assert got == "".join(f'"{i}","v{i}"\n' for i in range(n))
    meta = {r.batch_id: r for r in table_metadata(table).collect()}
    assert len(meta) == -(-n // 100) and sum(r.rows_cnt for r in meta.values()) == n and meta[0].offset == 0
    assert [r.i for r in read_batch(table, 0).sort("row_id").collect()] == list(range(min(n, 100)))
    assert read_batch(table, 99).count() == 0


def test_row_groups_as_batches(spark, tmp_path):
    import pyarrow.parquet as pq

    run(spark, tmp_path, "i,int64\n", "".join(f"{i}\n" for i in range(250)), row_groups_as_batches=True)
    files = [pq.ParquetFile(p) for p in (tmp_path / "t").glob("*.parquet")]
    assert max(f.metadata.row_group(g).num_rows for f in files for g in range(f.metadata.num_row_groups)) <= 100


def test_several_files_keep_path_order(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"p{k}.csv", "".join(f"{k * 10 + i}\n" for i in range(10)))
    raw = read_text_rows(spark, str(tmp_path / "p*.csv"), 1)
    assert [(r.row_id, r._c0) for r in B.number_file_rows(raw).sort("row_id").collect()] == [(i, str(i)) for i in range(30)]


@pytest.mark.parametrize("bad", ["1\n", "1,2,3\n", '"a"x,1\n', "x,1\n", ",1\n", "9223372036854775808,1\n"])
def test_bad_records_raise_and_commit_nothing(spark, tmp_path, bad):
    with pytest.raises(Exception):
        run(spark, tmp_path, "a,int64\nb,int64\n", "5,6\n" + bad)
    assert not (tmp_path / "t/_SUCCESS").exists()


def test_integer_parse(spark):
    good = {" 7": 7, "+7": 7, "12abc": 12, "3000.00": 3000, "0x10": 0, "1e3": 1, "4\r": 4, "-0": 0}
    rows = spark.createDataFrame([(k,) for k in good] + [(None,)], "t string").select("t", parse_int64(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == good | {None: None}


def test_schema_descriptor(spark, tmp_path):
    s = S.parse_descriptor('a,int64\n"x,y",string\na,string\n,string\n')
    assert S.fields_of(s) == [("a", "int64"), ("x,y", "string"), ("a", "string"), ("", "string")] and len(set(s.names)) == 4
    assert S.same_schema(S.parse_descriptor(S.render_descriptor(s)), s) and S.column_count(S.parse_descriptor("")) == 0
    assert S.flat(s)[:3] == [4, "a", "int64"] and S.field_at(s, 1) == ("x,y", "string")
    for bad in ("a\n", "a,int64,z\n", "a,INT64\n", "a, int64\n", "a,int64\r\n", "a,float\n", "\n"):
        with pytest.raises(ValueError):
            S.parse_descriptor(bad)
    for token in ("int64", "string"):
        assert token_of(data_type_of(token)) == token


def test_dialects(spark, tmp_path):
    for same in (dict(delimiter='"'), dict(delimiter="\n"), dict(quote="\n"), dict(delimiter="ab")):
        with pytest.raises(ValueError):
            Dialect(**same)
    d = Dialect(";", "'", "|")
    df = spark.createDataFrame([(0, "a;b", "it's"), (1, "", "x|y")], "row_id bigint, a string, b string")
    write_single_file(df, str(tmp_path / "o.csv"), "row_id", d)
    assert (tmp_path / "o.csv").read_text() == "'a;b';'it''s'|'';'x|y'|"
    back = B.number_file_rows(read_text_rows(spark, str(tmp_path / "o.csv"), 2, d)).sort("row_id").select("_c0", "_c1")
    assert [tuple(r) for r in back.collect()] == [("a;b", "it's"), ("", "x|y")]


def test_append_and_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a", "b")], "x string, y string")
    for mode in ("overwrite", "append", "append"):
        write_rows(df, str(tmp_path / "f"), mode=mode)
    assert spark.read.csv(str(tmp_path / "f")).count() == 3
    write_rows(df, str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f")).count() == 1


def test_missing_table_leaves_the_target(spark, tmp_path):
    target = put(tmp_path / "o.csv", "keep")
    with pytest.raises(FileNotFoundError):
        extract_table(spark, str(tmp_path / "none"), target)
    assert open(target).read() == "keep"


def test_cli(spark, tmp_path):
    for argv in ([], ["create_table"], ["extract_table", "a"], ["create_table", "a", "b", "c", "d"], ["other", "a", "b"]):
        assert cli.main(argv) == 111
    s, d, t, o = put(tmp_path / "s", "a,string\n"), put(tmp_path / "d", "x\n"), str(tmp_path / "t"), str(tmp_path / "o")
    assert cli.main(["create_table", s, d, t]) == 0 and cli.main(["extract_table", t, o]) == 0 and open(o).read() == '"x"\n'


def test_exact_tokenizer():
    t = lambda text, **k: list(tokenize(text, **k))
    assert t("a,,c,\n") == [["a", "", "c", ""]] and t("\n") == [[""]] and t("") == [] and t(",,,\n") == [[""] * 4]
    assert t('a""b,"x ""y"""\n') == [['a"b', 'x "y"']] and t('"p,q",\n"m\nn"\n') == [["p,q", ""], ["m\nn"]]
    assert t("a,b") == [["a", "b"]] and t("a,b", final="drop") == [["a"]] and t("a\r\n") == [["a\r"]]
    for bad in ('a"b\n', '"abc"x\n', '"x" ,y\n', '"open'):
        with pytest.raises(MalformedRecord):
            t(bad)
    assert t('k\n"a"x\nz\n', malformed="stop") == [["k"]]


def test_binary_file(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    schema = S.make_schema([("a", "int64"), ("b", "int64"), ("name123", "string"), ("d", "int64")])
    t = B.batch_of_columns(spark, [[1, 5, -9], [2, 6, 0], ["ab", "", "héllo"], [4, 8, 2**62]], schema)
    write_batch_file(t, path, 2)
    f = read_footer(path)
    assert f.fields == S.fields_of(schema) and [b[1:] for b in f.batches] == [(4, 2), (4, 1)]
    back = read_batch_file(spark, path)
    assert [tuple(r)[2:] for r in back.sort("row_id").collect()] == [(1, 2, "ab", 4), (5, 6, "", 8), (-9, 0, "héllo", 2**62)]
    assert [r.row_id for r in back.filter("batch_id = 1").collect()] == [2] and back.filter("batch_id = 9").count() == 0
    size = B.layout_size(B.assign_batches(t, 2), S.fields_of(schema)).collect()[0][0]
    assert size == os.path.getsize(path)
    # A later batch may hold fewer columns than the schema.
    raw = struct.pack("<q", 7)
    from rowloom.sources.binary_file import Footer, encode_footer

    (tmp_path / "n.bin").write_bytes(raw + encode_footer(Footer([("a", "int64"), ("b", "string")], [(0, 1, 1)]), 8))
    assert [tuple(r) for r in read_batch_file(spark, str(tmp_path / "n.bin")).collect()] == [(0, 0, 7, None)]


def test_column_operators(spark):
    schema = S.make_schema([("a", "int64"), ("b", "string")])
    t = B.assign_batches(B.batch_of_columns(spark, [[1, 2], ["x", "y"]], schema))
    assert B.column_count(t) == 2 and not B.is_empty(t) and B.is_empty(B.empty_batch(spark, S.make_schema([])))
    assert [r.value for r in B.element_at(t, 1, 1).collect()] == ["y"]
    a, b = B.column_at(t, 0), B.column_at(t, 1)
    eq = lambda x, y: B.columns_equal(x, y).collect()[0][0]
    assert eq(a, a) and not eq(a, b) and not eq(a, a.filter("row_id = 0")) and not eq(b, b.withColumn("value", F.lit("x")))
    assert B.add_column(t, a, "c").count() == 2
    with pytest.raises(Exception):
        B.add_column(t, a.filter("row_id = 0"), "c").count()
    for columns in ([[1]], [[1], ["x", "y"]], [["no"], ["x"]]):
        with pytest.raises(Exception):
            B.batch_of_columns(spark, columns, schema).count()


FIELD = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=8)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(FIELD, st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=8))
def test_any_text_survives(spark, tmp_path_factory, data):
    tmp = tmp_path_factory.mktemp("p")
    schema = S.make_schema([("t", "string"), ("n", "int64")])
    df = B.batch_of_columns(spark, [[x for x, _ in data], [n for _, n in data]], schema)
    write_single_file(df, str(tmp / "a.csv"), "row_id")
    import_csv(spark, schema, str(tmp / "a.csv"), str(tmp / "t"))
    assert [(r.t, r.n) for r in open_table(spark, str(tmp / "t")).sort("row_id").collect()] == data
    assert list(tokenize((tmp / "a.csv").read_bytes().decode())) == [[x, str(n)] for x, n in data]


def plain_records(text):
    """The record rules, a character at a time; None if malformed."""
    out, record, i = [], [], 0
    while i < len(text):
        field = ""
        if text[i] == '"':
            i += 1
            while True:
                if i >= len(text):
                    return None
                if text[i] != '"':
                    field, i = field + text[i], i + 1
                elif text[i + 1 : i + 2] == '"':
                    field, i = field + '"', i + 2
                else:
                    i += 1
                    break
            if i < len(text) and text[i] not in ",\n":
                return None
        else:
            while i < len(text) and text[i] not in ",\n":
                if text[i] == '"':
                    if text[i + 1 : i + 2] != '"':
                        return None
                    i += 1
                field, i = field + text[i], i + 1
        record.append(field)
        if i < len(text) and text[i] == ",":
            i += 1
            if i == len(text):
                out.append([*record, ""])
            continue
        i += 1
        out.append(record)
        record = []
    return out


@settings(max_examples=400, deadline=None)
@given(st.text('a",\n\r', max_size=12))
def test_tokenizer_against_the_rules(text):
    want = plain_records(text)
    if want is None:
        with pytest.raises(MalformedRecord):
            list(tokenize(text))
    else:
        assert list(tokenize(text)) == want


@pytest.mark.parametrize("coalesce", ["true", "false"])
@pytest.mark.parametrize("partitions", [16, 40])
def test_rows_are_numbered_by_rank(spark, coalesce, partitions):
    """Over many range partitions, with wide rows, repeated keys and clashing names, each row once and by its rank."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": coalesce, "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 30_000
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("k"), (F.col("id") % 7).alias("_part"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"), "id")
        rows = B.number_by_key(df, ["k", "id"])
        assert sorted(rows.columns) == sorted([*df.columns, "row_id"])
        got = rows.select("row_id", "k", "id", "_part", F.length("wide").alias("w")).sort("row_id").collect()
        want = sorted((r.k, r.id) for r in df.select("k", "id").collect())
        assert [r.row_id for r in got] == list(range(n)) and [(r.k, r.id) for r in got] == want
        assert all(r["_part"] == r.id % 7 and r.w == 256 for r in got)
        assert B.number_by_key(df.limit(0), ["k"]).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_part_files_in_number_order(spark, tmp_path):
    for k in (9, 10, 99999, 100000):
        put(tmp_path / f"part-{k:05d}-x.csv", f"{k}\n")
    rows = B.number_file_rows(read_text_rows(spark, str(tmp_path), 1)).sort("row_id").collect()
    assert [r._c0 for r in rows] == ["9", "10", "99999", "100000"]


def test_ordered_part_files(spark, tmp_path):
    df = spark.range(5000).select((4999 - F.col("id")).alias("row_id"), F.concat(F.lit('q"\n,'), F.col("id").cast("string")).alias("t"))
    for exact in (False, True):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        write_ordered_files(df, str(tmp_path / "f"), "row_id")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert len(list((tmp_path / "f").glob("part-*"))) > 1
        rows = csv_rows(spark, S.make_schema([("t", "string")]), str(tmp_path / "f"), exact=exact).sort("row_id").collect()
        assert [r.t for r in rows] == [f'q"\n,{4999 - i}' for i in range(5000)] and rows[-1].batch_id == 49


def test_ragged_records(spark, tmp_path):
    path = put(tmp_path / "r.csv", 'a,b,c\n"two\nlines",x\n\n1,2\n')
    assert [r.fields for r in read_records(spark, path).sort("row_id").collect()] == [["a", "b", "c"], ["two\nlines", "x"], [""], ["1", "2"]]
    assert read_records(spark, put(tmp_path / "e.csv", "")).count() == 0
    bad = put(tmp_path / "b.csv", 'k\n"a"x\nz\n')
    assert [r.fields for r in read_records(spark, bad, malformed="stop").collect()] == [["k"]]


def test_offsets_over_spans(spark, monkeypatch):
    monkeypatch.setattr(B, "BATCH_SPAN", 3)
    t = B.assign_batches(spark.range(1000).select(F.col("id").alias("row_id"), F.repeat(F.lit("x"), (F.col("id") % 11).cast("int")).alias("t")), 10)
    at = 0
    for r in B.batch_metadata(t).sort("batch_id").collect():
        assert r.offset == at
        at += r.bytes


def test_binary_strings_as_bytes(spark, tmp_path):
    raw = struct.pack("<q", 3) + b"\xff\x00a"
    from rowloom.sources.binary_file import Footer, encode_footer

    (tmp_path / "n.bin").write_bytes(raw + encode_footer(Footer([("b", "string")], [(0, 1, 1)]), len(raw)))
    assert bytes(read_batch_file(spark, str(tmp_path / "n.bin"), "binary").collect()[0].b) == b"\xff\x00a"
    with pytest.raises(Exception):
        read_batch_file(spark, str(tmp_path / "n.bin")).collect()
    with pytest.raises(ValueError):
        local_path("hdfs://host/x.bin")


def test_binary_runs_of_batches(spark, tmp_path, monkeypatch):
    t = B.assign_batches(spark.range(1050).select(F.col("id").alias("row_id"), F.repeat(F.lit("y"), F.lit(20)).alias("t")))
    write_batch_file(t, str(tmp_path / "x.bin"))
    assert read_batch_file(spark, str(tmp_path / "x.bin")).rdd.getNumPartitions() == 1
    rows = read_batch_file(spark, str(tmp_path / "x.bin")).sort("row_id").collect()
    assert [(r.row_id, r.batch_id) for r in rows] == [(i, i // 100) for i in range(1050)]


def test_cli_forms(spark, tmp_path):
    s, d, t, o = put(tmp_path / "s", "a,string\nb,string\n"), put(tmp_path / "d", 'x""y,1\n\n'), str(tmp_path / "t"), str(tmp_path / "o")
    with pytest.raises(Exception):  # the blank line is a record of one field
        cli.main(["create_table", "--exact", s, d, t])
    d = put(tmp_path / "d2", 'x""y,1\n')
    assert cli.main(["create_table", "--exact", "--binary", s, d, f"{t}.bin"]) == 0 and cli.main(["extract_table", "--binary", f"{t}.bin", o]) == 0
    assert open(o).read() == '"x""y","1"\n'
    d = put(tmp_path / "d3", "p,q\nr,s,open")
    assert cli.main(["create_table", "--drop-last", s, d, t]) == 0 and cli.main(["extract_table", "--parts", t, f"{o}.parts"]) == 0
    assert "".join(p.read_text() for p in sorted((tmp_path / "o.parts").glob("part-*"))) == '"p","q"\n"r","s"\n'


def test_binary_file_by_several_tasks(spark, tmp_path):
    """A file that many tasks wrote, also from rows with gaps in their numbers, is as the layout says, byte for byte."""
    from rowloom.sources.binary_file import Footer, encode_footer

    t = spark.range(1050).select((1049 - F.col("id")).alias("row_id"), F.col("id").alias("i"), F.repeat(F.lit("é"), (F.col("id") % 9).cast("int")).alias("t"))
    want, batches, path = b"", [], str(tmp_path / "x.bin")
    for b in range(0, 1050, 100):
        ids = [1049 - r for r in range(b, min(b + 100, 1050))]
        batches.append((len(want), 2, len(ids)))
        want += struct.pack(f"<{len(ids)}q", *ids) + b"".join(struct.pack("<q", 2 * (i % 9)) + "é".encode() * (i % 9) for i in ids)
    want += encode_footer(Footer([("i", "int64"), ("t", "string")], batches), len(want))
    assert tasks_that_write(spark, lambda: write_batch_file(t, path)) > 1
    assert open(path, "rb").read() == want and os.listdir(tmp_path) == ["x.bin"]
    write_batch_file(t.withColumn("row_id", F.col("row_id") * 3 + 7), path)
    assert open(path, "rb").read() == want
    with pytest.raises(Exception):  # not numbered, though said to be: the file stays
        write_batch_file(t.filter("row_id <> 500"), path, numbered=True)
    assert open(path, "rb").read() == want and os.listdir(tmp_path) == ["x.bin"]
    write_batch_file(t.limit(0), path)
    assert read_footer(path).batches == [] and read_batch_file(spark, path).count() == 0


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of few bytes, a split a task."""
    conf = {"spark.sql.files.maxPartitionBytes": "7", "spark.sql.files.openCostInBytes": "7"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


SPLIT_TEXTS = ["", "\n", "a,b\n", 'k,"two\nlines",z', '"""q"",\n\n,""",x\n\n"",\n', "\ufeffa,b\n\u00e9\u00e9\u00e9\u00e9,\U0001f389\n", "\ufeffa", '"' + "long\n" * 40 + '",1\nx,"y"\n', 'a""b,"c\r"\nd,e,f,\r\n']


@pytest.mark.parametrize("n", range(len(SPLIT_TEXTS)))
def test_exact_records_over_splits(spark, tmp_path, small_splits, n):
    """Records of a file that many tasks read, each from a few bytes, are those of the whole text."""
    text = SPLIT_TEXTS[n]
    for final in ("keep", "drop"):
        rows = read_records(spark, put(tmp_path / "x.csv", text), final=final).sort("row_id").collect()
        assert [(r.row_id, r.fields) for r in rows] == list(enumerate(tokenize(text, final=final)))


def test_exact_records_of_several_files_over_splits(spark, tmp_path, small_splits):
    for k in (9, 10):
        put(tmp_path / f"part-{k:05d}-x.csv", f'"{k}\n",a\n' * 4 + f"{k},end")
    rows = read_records(spark, str(tmp_path)).sort("row_id").collect()
    assert [(r.row_id, r.fields) for r in rows] == list(enumerate([["9\n", "a"]] * 4 + [["9", "end"]] + [["10\n", "a"]] * 4 + [["10", "end"]]))
    for bad in ('ok,1\n"a"x\nmore\n', 'ok,1\nmore\n"open\nand\nmore'):
        with pytest.raises(Exception, match="MalformedRecord"):
            read_records(spark, put(tmp_path / "bad.csv", bad)).collect()


def test_exact_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    path = put(tmp_path / "x.csv", "ab,c\n" * 30)
    assert read_records(spark, path).select(F.spark_partition_id().alias("p")).distinct().count() > 1


@settings(max_examples=400, deadline=None)
@given(st.text('a",\n', max_size=14))
def test_line_states_against_the_rules(text):
    """Lines that end inside quotes, from either beginning, tell records apart."""
    if (want := plain_records(text)) is None:
        return
    from rowloom.sources.split_csv import ends_inside

    begun, continued = ends_inside(Dialect())
    records, inside = [], False
    for line in text.removesuffix("\n").split("\n") if text else []:
        if inside:
            records[-1] += f"\n{line}"
        else:
            records.append(line)
        inside = (continued if inside else begun).match(line.encode()) is not None
    assert not inside and [f for r in records for f in tokenize(f"{r}\n")] == want


BUILT_IN_TEXTS = {
    "quotes in bare fields": 'a"b,c\nd"",e\nf,"g\nh"\ni"j"k,"l"\n',
    "blank lines": '\na,b\n\n\n"c\n\nd",\n \t,e\n\n',
    "no line break at the end": "a,b\nc,d",
    "open at the end": 'a,b\nc,"d\ne\n',
    "open at the end without line break": 'a,b\nc,"d\n\ne',
    "byte order mark": '\ufeff"a",\u00e9\r\n\U0001f389,"\r"\n',
    "backslash": '"\\","\\"\n\\",x\n"\\""",",\n,"""\n',
    "malformed": 'a,b\n"c"d,e\nf,g\n',
    "ragged": "a,b\nc,d,e\n",
    "space after a quote": 'a,b\n"c" ,d\n',
}


@pytest.mark.parametrize("name", BUILT_IN_TEXTS)
def test_built_in_parser_over_splits(spark, tmp_path, small_splits, monkeypatch, name):
    """The rows of one task by file, or its refusal, also from splits of a few bytes."""
    from rowloom.sources import split_csv

    def rows():
        try:
            return [tuple(r) for r in split_csv.read_numbered_rows(spark, path, 2).sort("row_id").select("row_id", "_c0", "_c1").collect()]
        except Exception:
            return "refused"

    path = put(tmp_path / "x.csv", BUILT_IN_TEXTS[name])
    want = rows()
    monkeypatch.setattr(split_csv, "SPLIT_BYTES", 0)
    assert rows() == want
    assert split_csv.read_numbered_rows(spark, put(tmp_path / "y.csv", "ab,c\n" * 30), 2).select(F.spark_partition_id()).distinct().count() > 1


def test_single_file_by_several_tasks(spark, tmp_path):
    df = spark.range(5000).select((4999 - F.col("id")).alias("row_id"), F.concat(F.lit('q"\n,'), F.col("id").cast("string")).alias("t"))
    path = tmp_path / "o.csv"
    assert tasks_that_write(spark, lambda: write_single_file(df, str(path), "row_id")) > 1
    assert path.read_text() == "".join(f'"q""\n,{4999 - i}"\n' for i in range(5000)) and {p.name for p in tmp_path.iterdir()} <= {"o.csv", ".o.csv.crc"}
    write_single_file(df.limit(0), str(path), "row_id")
    assert path.read_text() == ""


def test_numbering_shuffles_no_rows(spark, tmp_path):
    """Numbers are joined to the rows of files and of a sorted table by a broadcast, however large these are."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (B.number_file_rows(read_text_rows(spark, put(tmp_path / "x.csv", "a\nb\n"), 1)), B.number_by_key(spark.range(9).toDF("k"), ["k"])):
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
