"""What the operators share: tables in the cluster's shared folder, and word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bytes that separate words, as a regular expression class, and a word.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests on one
    machine, a temporary one."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not _own_folder:
        _own_folder.append(f"file://{tempfile.mkdtemp(prefix='rowloom-')}")
    return _own_folder[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends there, so a lost executor costs no more
    than the reading, and the size is known to the planner."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    trimmed_driver(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def deleted(df: DataFrame) -> None:
    """Remove a table of :func:`written` that nothing reads any more."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps. Spark deletes them when the driver's garbage collector finds
    their handles, which a quiet driver seldom runs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed_driver(spark)


def trimmed_driver(spark: SparkSession) -> str:
    """Gives the memory that the driver's JVM holds free beside its heap back to the system; what the JVM says of it,
    nothing where it can't. Compiling the code of large plans takes hundreds of MB for moments, which the C library
    keeps otherwise."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    named, thing, word = jvm.java.lang.Class.forName, jvm.java.lang.Object, jvm.java.lang.String
    try:  # by reflection, as the server's own class is in a closed module
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds = array(jvm.java.lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        return named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, array(thing, commands, "systemTrimNativeHeap", array(thing), array(word)))
    except Py4JError:  # an older JVM, or one on another system
        return ""


def trimmed_executors(spark: SparkSession) -> None:
    """Lets the executors' JVMs collect their garbage, upon which they give the heap that finished steps have filled back
    to the system. Else a heap stays as large as it ever was while only Python works, and counts beside the workers.
    There is a task for each core, so that idle executors all get some; one that gets none just keeps its heap."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores before those that ``df`` has as columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased (A-Z only) text as UTF-8: bytes.lower and bytes.split know ASCII alone, and split
    at exactly the bytes of SPACES."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_of(key: Column) -> Column:
    """crc32 of the key as text; of the empty text for null."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))
