"""Small file operations through Hadoop's FileSystem, so that paths of any store Spark knows work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that the driver copies at once.
COPY_BYTES = 4 << 20
_own_folder: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in
    tests on one machine, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _own_folder:
            _own_folder.append(f"file://{tempfile.mkdtemp(prefix='rowloom-tables-')}")
        base = _own_folder[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def evaluated(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read from there: every later use sees the same rows, and what an
    executor loses is read again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def join_parts(spark: SparkSession, folder: str, target: str) -> None:
    """Put the part files of ``folder``, in the order of their numbers, as one file at ``target`` (replaced), then drop
    the folder. A part alone is moved; several are copied by the driver in blocks, as a store appends to one file from
    one place. A result without rows has no part file, which gives an empty target."""
    fs, p, jvm = _fs(spark, folder)
    to = jvm.org.apache.hadoop.fs.Path(target)
    parts = sorted((int(name.split("-")[1]), name) for s in fs.listStatus(p) if (name := s.getPath().getName()).startswith("part-"))
    paths = [jvm.org.apache.hadoop.fs.Path(p, name) for _, name in parts]
    if len(paths) != 1:
        whole = jvm.org.apache.hadoop.fs.Path(p, "_whole")
        out = fs.create(whole, True)
        try:
            for part in paths:
                from_part = fs.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(from_part, out, COPY_BYTES, False)
                finally:
                    from_part.close()
                fs.delete(part, False)
        finally:
            out.close()
        paths = [whole]
    fs.delete(to, True)
    if to.getParent() is not None:
        fs.mkdirs(to.getParent())
    if not fs.rename(paths[0], to):
        raise OSError(f"can't move {paths[0]} to {target}")
    fs.delete(p, True)
