"""Mixing sources to target weights, in DataFrame operations only.

Each row gets a random key (a hash of its id). Within a source rows are range-sorted by key, and prefix sums of
their sizes are taken in two levels: over ranges of the key space (uniform, as keys are hashes) and within a range.
A source that holds a third of all rows is thereby spread over as many tasks as there are ranges. The mix takes
whole passes over a source, then rows in key order up to the exact word budget; the row at the cut is taken in part.

Only (source, range) sums, never rows, meet in one task; the water-filling of targets sees one row a source.

Cases: a null text has size 0; null is a source of its own, ordered last; null ids share the key of the empty text;
rows that repeat an id are ordered by size, rows that repeat both are interchangeable. No rows give no rows; a
source without words has target 0. Other columns are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import SPACES, WORD, table, unused, written

# Fixed values of the mix: weights that sources get in turn, share of all words, most passes over a source.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Hexadecimal digits of the key that name its range: 16**3 ranges.
RANGE_DIGITS = 3


def random_key(key: Column, seed: str) -> Column:
    return F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 16)


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sources(source, source_size) with target: shares by weight, stopped at ``most`` times the size, the excess
    reshared. In the order of cap over weight the capped sources come first, so the level follows from prefix sums."""
    everything = Window.partitionBy()
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", turn.cast("bigint")).withColumn("cap", F.col("source_size") * most)
    s = s.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything).cast("double") * share - capped.cast("double")) / open_weight.cast("double")
    s = s.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.col("level") < F.col("ratio")
    s = s.withColumn("water", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("place"))).over(everything))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix_amounts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                most: int = MOST, seed: str = "mix|", range_digits: int = RANGE_DIGITS) -> DataFrame:
    """One row for each row of ``df``: id, source, size, source_size, target, taken (words, repeats counted)."""
    key = random_key(F.col(id_col), seed)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    rows = written(rows, "mix-sizes")  # texts are read and counted once
    rows = rows.withColumn("range", F.substring("key", 1, range_digits)).withColumn("name", F.concat(F.lit("="), "source")).withColumn("name", F.coalesce("name", F.lit("")))
    sums = rows.groupBy("name", "range").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    sources = sums.groupBy("name").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    targets = _targets(sources.select("source", "source_size"), weights, share, most).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("name", "range", before.alias("start")).join(targets, "name")
    ordered = Window.partitionBy("name", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(ordered), F.lit(0))).join(starts, ["name", "range"])
    budget = F.floor("target").cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - passes * F.col("source_size") - F.col("start") - F.col("within")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word, from its first word on."""
    lead = F.regexp_replace(text, f"^{SPACES}", "")
    parts = F.split(lead, SPACES, n + 1)
    tail = F.when(F.size(parts) > n, F.length(F.element_at(parts, -1))).otherwise(F.lit(0))
    return F.regexp_replace(F.substring(lead, F.lit(1), F.length(lead) - tail), f"{SPACES}$", "")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: ``df``'s columns, a row for each time it is taken, the row at the cut with its first words
    alone. Rows without words are in no mix. Ids must be unique, as they are after deduplication."""
    key, size, taken, time = unused(df, "_id", "_size", "_taken", "_time")
    amounts = mix_amounts(df, id_col, text_col, source_col, **how).filter("taken > 0").select(F.col(id_col).alias(key), F.col("size").alias(size), F.col("taken").alias(taken))
    times = F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int")))
    rows = df.filter(F.col(text_col).rlike(WORD)).join(amounts, F.col(id_col).eqNullSafe(F.col(key))).withColumn(time, times)
    words = F.least(F.col(size), F.col(taken) - (F.col(time) - 1) * F.col(size))
    text = F.when(words < F.col(size), first_words(F.col(text_col), words.cast("int"))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in df.columns])


def op8_mix_sources(spark, sf_dir):
    return mix_amounts(table(spark, sf_dir, "documents")).drop("source")


ORACLE = r"""
WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM r GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, cap::DOUBLE / weight AS ratio, row_number() OVER q AS place,
        (CAST(1.5 AS DOUBLE) * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
        / (sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW q AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, place) FROM o WHERE level < ratio) * weight, cap::DOUBLE)) AS target FROM o),
p AS (SELECT r.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM r),
b AS (SELECT p.*, source_size, target, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, budget - passes * source_size - before)))::BIGINT AS taken FROM b
"""
