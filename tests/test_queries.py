import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import SF, assert_same, database

from rowloom import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_matches_sql(spark, name):
    assert_same(Q.queries()[name](spark, SF), Q.oracle_sql()[name])


def test_batch_filter_reaches_the_scan(spark):
    t = Q.stored(spark, "/root/testdata/sf0.001", "documents")
    plan = Q.read_batch(t, 1).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(batch_id,1)" in plan and "ReadSchema: struct<doc_id:bigint,batch_id:bigint>" in plan


def test_entry_imports():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("left", ["nothing", "cache"])
def test_entry_without_the_corpus_operators(tmp_path, left):
    """Both folders and the pipeline away, with and without what Python leaves of a deleted package."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "rowloom", tmp_path / "rowloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if left == "cache":
        (tmp_path / "rowloom/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.split() == [str(len(Q.queries()))] * 2, done.stderr


def test_all_rows_at_a_larger_size(spark):
    """As many rows as the SQL gives where range shuffles have several partitions."""
    sf = "/root/testdata/sf0.1"
    db = database(sf)
    for name in ("csv_roundtrip_documents", "csv_roundtrip_orders", "batch_assign", "add_column"):
        assert Q.queries()[name](spark, sf).count() == db.execute(f"SELECT count(*) FROM ({Q.oracle_sql()[name]})").fetchone()[0]
