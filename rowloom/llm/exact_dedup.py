"""Exact deduplication, in DataFrame operations only.

Copies are combined in three stages: each task's own rows (the partial aggregate), then groups of (digest, salt),
then the salt winners of a digest. Every stage groups by the full text beside the digest, so two texts with one
digest never merge. A text held by a third of all rows reaches the shuffle as at most one row for each task and
salt, and the way back to the rows is by (digest, salt), which spreads it over all salts.

Only digests and ids travel on the way back. That is exact for a digest with one text; the digests with several,
if a check of the combined groups finds any, go back by (digest, text).

Cases: a null text is an empty text. Null ids are never the largest; a group of null ids alone keeps null. Rows that
repeat both id and text are the same row: all of those with the largest id count as kept. No rows give no rows.
Other columns are neither read nor disturbed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import table, unused, written

#: Parts of a digest's rows, at the least and at the most (they are kept as bits of a long).
SALTS, MOST_SALTS = 16, 62


def sha256_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combined(rows: DataFrame) -> DataFrame:
    """One row for each (key, text), partitioned by key."""
    salted = rows.groupBy("key", "salt", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    return salted.repartition(F.col("key")).groupBy("key", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None, digest: Callable[[Column], Column] = sha256_key) -> DataFrame:
    """One row for each row of ``df``: id, keep_id (the largest id of its equal texts), group_size, kept,
    text_sha256. ``digest`` may be any function of the text: a weak one costs time, not exactness. ``salts``, unset, are
    as many as the cluster's tasks, between SALTS and MOST_SALTS."""
    if salts is None:
        salts = min(MOST_SALTS, max(SALTS, df.sparkSession.sparkContext.defaultParallelism))
    if not 1 <= salts <= MOST_SALTS:
        raise ValueError(f"1 to {MOST_SALTS} salts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), digest(text).alias("key"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int").alias("salt"))
    per_key = written(_combined(rows).groupBy("key").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
                                                        F.bit_or("salts").alias("salts")), "exact-keys")
    present = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.getbit(F.col("salts"), i) == 1)
    single = per_key.filter("texts = 1").select("key", F.explode(present).alias("salt"), "keep_id", "group_size")
    sha = F.sha2(F.col("text"), 256) if digest is not sha256_key else F.lower(F.hex("key"))
    slim = rows.select("id", "key", "salt", *([F.col("text")] if digest is not sha256_key else []))
    out = slim.join(single, ["key", "salt"]).select("id", "keep_id", "group_size", sha.alias("text_sha256"))
    shared = per_key.filter("texts > 1").select("key")
    if not shared.isEmpty():
        several = rows.join(shared, "key")
        groups = _combined(several).select("key", "text", "keep_id", "group_size")
        out = out.unionByName(several.join(groups, ["key", "text"]).select("id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text a row with a larger id has, each text once; columns as they are. Needs
    ids that tell texts apart: rows of one id are kept or dropped together."""
    (key,) = unused(df, "_kept_id")
    kept = exact_groups(df, id_col, text_col).filter("kept").select(F.col(id_col).alias(key)).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")


def op3_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""
