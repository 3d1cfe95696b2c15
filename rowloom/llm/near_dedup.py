"""Near-duplicate detection by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles, each hashed once to 63 bits. Its sketch is the K smallest
hashes. Documents of equal sets are one class at once; the rest is done between classes:

1. Inverted lists of retained values. Two sets of similarity 0.8 share many retained values: at least ``t`` of them,
   where t is exact for sets that fit into the sketch, and for larger sets is so far below the expected 0.8 K that
   fewer occur with probability below 1e-9. As in prefix filtering, a class therefore enters only the lists of its
   ``|sketch| - t + 1`` rarest values: of two linked classes' lists one at least is common. A shingle that a third
   of all documents have is thus in a list only for documents made of little else.
2. Star pairs: every class of a list against a few classes of the list, linear in the lists' sizes. The union sketch
   of a pair estimates the similarity; pairs below t of K are dropped, most of them by parity bitmaps of the sets
   or sketches before these are compared. The rest is verified by exact intersection of
   the full sets. Verified links give connected components. Further rounds do so with other classes as centres, for
   pairs between components in the lists that still hold several.
3. Last, all pairs between components in such lists are estimated and verified. In a group of thousands of near copies
   the stars have joined the members by then, so no pair within is made; yet no link between components is lost.
   Of each list, the classes outside the component that has most of it meet the others, and within the join the
   positions of the common value and the parity bitmaps bound the overlap, so copies too far from all others
   are passed over there.

No list, bucket or group is capped. Joins are between tables in the shared folder with both sides exchanged by key,
which adaptive execution splits where a key is hot.

Cases: null, empty and blank texts have no shingles and are linked with nothing; fewer words than a shingle has give
the whole sequence as one. Null ids take part through their text; their component is the smallest id in it, null if
there is none. Rows that repeat id and text are alike in every column. No rows give no rows. Other columns are not
read."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import deleted, freed, table, unused, written
from rowloom.llm.words import slices, split_words, trimmed

#: Retained values of a set, and how many two linked large sets share at the least.
K, SHARED = 96, 48
WIDTH, PERCENT = 5, 80
#: Centres of a list in each round of star pairs.
STARS = (3, 8)
_NULL_ID = -(1 << 63)
#: Words of 64 bits in a parity bitmap. Sets up to SMALL have one of all members, as it fills up with larger ones;
#: those have one of the sketch. Sets that may be linked to either kind have both.
PARITY_WORDS, SMALL = 8, 800
_WHOLE, _SKETCH = [f"w{i}" for i in range(PARITY_WORDS)], [f"s{i}" for i in range(PARITY_WORDS)]
#: Retained values before a list's own that tell whether two of its classes have met in another.
PRIOR = 4
#: Words of 64 bits in the bitmap that tells which rows' texts are wanted: 2 MB at most, whatever the input.
BITMAP_WORDS = 1 << 17


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Hashes of each text's shingles, in text order, with repeats."""
    from xxhash import xxh64_intdigest

    words, which, offsets = split_words(texts, lower=True)
    sizes = np.diff(offsets).tolist()
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))[which]
    factor = np.uint64(0x9E3779B97F4A7C15)

    def mixed(x: np.ndarray) -> np.ndarray:  # the finalizer of splitmix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)

    def folded(parts: list[np.ndarray], length: int) -> np.ndarray:
        x = np.full(len(parts[0]), length, np.uint64)
        for p in parts:
            x = x * factor + p
        return mixed(x)

    n = len(h) - width + 1
    rolling = folded([h[i : i + n] for i in range(width)], width) if n > 0 else np.zeros(0, np.int64)
    out, at = [], 0
    for size in sizes:
        if size >= width:
            out.append(rolling[at : at + size - width + 1])
        elif size:
            out.append(folded([h[at + i : at + i + 1] for i in range(size)], size))
        else:
            out.append(np.zeros(0, np.int64))
        at += size
    return out


def least_shared(n: Column, k: int = K, shared: int = SHARED, percent: int = PERCENT) -> Column:
    """Retained values that a set of n has in common with any linked one."""
    return F.least(F.ceil(n * percent / 100).cast("int"), F.lit(shared))


def parity_of(values: np.ndarray) -> np.ndarray:
    """A bitmap whose bit i tells whether an odd number of values end in i. The bitmaps of two sets differ in at most
    as many bits as the sets differ in members."""
    odd = np.bincount(values & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, width: int, k: int = K, percent: int = PERCENT) -> DataFrame:
    """id, th (hash of the text), n (set size), digest (of the set), sketch, whole and part (bitmaps of the set and the sketch, null
    where the size calls for the other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for some in slices(batches, 2, 1000):
            sets = [np.unique(s) for s in shingles(some.column(2), width)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                                              pa.array([s[:k] for s in sets], pa.list_(pa.int64())), pa.array([parity_of(s) if len(s) <= SMALL else None for s in sets], pa.list_(pa.int64())),
                                              pa.array([parity_of(s[:k]) if len(s) * 100 >= SMALL * percent else None for s in sets], pa.list_(pa.int64()))], names=["id", "th", "n", "digest", "sketch", "whole", "part"])
        trimmed()

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col)).mapInArrow(run, "id bigint, th bigint, n bigint, digest binary, sketch array<bigint>, whole array<bigint>, part array<bigint>")


def full_sets(df: DataFrame, needed: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """node, members (sorted hashes of the full set) for the classes of ``needed`` (node, id, th). A bitmap of hashes
    keeps nearly all other texts out of the shuffle; its table is bounded by BITMAP_WORDS rows, and so broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1, 1000):
            sets = [np.unique(s) for s in shingles(some.column(1), width)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "members"])

    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NULL_ID))
    texts = df.select(key.alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    bits = lambda: F.xxhash64("id", "th")
    word, bit = F.pmod(bits(), F.lit(BITMAP_WORDS)).alias("word"), F.shiftrightunsigned(bits(), 58).cast("int")
    needed = needed.withColumn("id", F.coalesce("id", F.lit(_NULL_ID)))
    bitmap = needed.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    texts = texts.withColumn("word", word).withColumn("bit", bit).join(F.broadcast(bitmap), "word").filter(F.getbit(F.col("bits"), F.col("bit")) == 1)
    found = texts.join(needed, ["id", "th"]).select("node", "text").dropDuplicates(["node"])
    return found.mapInArrow(run, "node bigint, members array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to node, comp: the smallest node reachable. Neighbours' minima with pointer jumping; each round is
    a written table, and the rounds grow with the logarithm of the longest path."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        ahead = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = labels.select("node", "comp").join(ahead, "comp").join(near, "node")
        labels = written(step.select("node", F.least("comp", "near", "next").alias("comp"), F.col("comp").alias("was")), "labels")
        if labels.filter("comp <> was").isEmpty():
            return labels.select("node", "comp")


def _close(x: Column, y: Column, percent: int) -> Column:
    """Set sizes that allow a link."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _enough(x: str, y: str, percent: int, shared: int) -> Column:
    """Whether the bitmaps of columns with the prefixes x and y, and the sizes, allow a link: by the similarity where
    they are of whole sets, by the shared values that :func:`likely_pairs` wants where they are of sketches."""
    apart = lambda bits: sum((F.bit_count(F.col(x + p).bitwiseXOR(F.col(y + p))) for p in bits), F.lit(0))  # noqa: E731  null if one has none
    both = F.col(f"{x}n") + F.col(f"{y}n")
    whole = (both - apart(_WHOLE)) * (100 + percent) >= both * 2 * percent
    held = F.col(f"{x}held") + F.col(f"{y}held")
    return _close(F.col(f"{x}n"), F.col(f"{y}n"), percent) & F.coalesce(whole, F.lit(True)) & F.coalesce(held - apart(_SKETCH) >= 2 * shared, F.lit(True))


def allowed_pairs(pairs: DataFrame, bitmaps: DataFrame, percent: int, shared: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps allow."""
    side = lambda x: bitmaps.select(*[F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in bitmaps.columns])
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_enough("a_", "b_", percent, shared)).select("a", "b")


def likely_pairs(pairs: DataFrame, classes: DataFrame, k: int, shared: int) -> DataFrame:
    """The pairs (a, b) that their union sketches allow."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    return written(both.withColumn("u", union).filter(common * k >= F.size("u") * shared).select("a", "b"), "likely")


def verified(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links by their full sets."""
    full = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m{x}"))
    counted = likely.join(full("a"), "a").join(full("b"), "b").select("a", "b", (F.size("ma") + F.size("mb")).alias("total"), F.size(F.array_intersect("ma", "mb")).alias("common"))
    return written(counted.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * percent).select("a", "b"), "links")


def _star_pairs(lists: DataFrame, stars: int, seed: str, percent: int) -> DataFrame:
    """lists(node, n, v, comp): distinct pairs (a, b) of each list's classes with ``stars`` of its classes, those of
    the smallest seeded hashes, in different components. The hashes are the classes' own, so lists of one group of
    near copies choose the same."""
    place = lambda i: F.struct(F.xxhash64(F.lit(f"{seed}{i}"), "node").alias("h"), "node", "n", "comp")
    ends = lists.groupBy("v").agg(*[F.min(place(i)).alias(f"e{i}") for i in range(stars)])
    centres = F.explode(F.array_distinct(F.transform(F.array(*[f"e{i}" for i in range(stars)]), lambda e: F.struct(e["node"].alias("p"), e["n"].alias("pn"), e["comp"].alias("pc")))))
    ends = written(ends.select("v", centres.alias("e")).select("v", "e.*"), "centres")
    return lists.join(ends, "v").filter((F.col("comp") != F.col("pc")) & _close(F.col("n"), F.col("pn"), percent)).select(*_ordered("node", "p")).distinct()


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def list_pairs(lists: DataFrame, bitmaps: DataFrame, percent: int, shared: int) -> DataFrame:
    """lists(node, n, v, pos, comp): distinct pairs (a, b) of each list's classes in different components that may be
    links. ``pos`` is the value's place among the class's retained values, rarest first, and ``top`` the largest of
    these. At the first value that two classes have in common, those before it in the class of the smaller ``top``
    would be retained by the other if it had them: so many members it lacks at the least. Two classes meet in every
    list that they share, but are passed over where one of the PRIOR values before it is common too: they have met at
    that value, or at the first in common, which nothing passes over."""
    of_node = Window.partitionBy("node").orderBy("pos")
    own = lists.select("*", *[F.lag("v", i + 1).over(of_node).alias(f"p{i}") for i in range(PRIOR)]).join(bitmaps.drop("n"), "node")
    shares = lists.groupBy("v", "comp").agg(F.count("*").alias("c")).groupBy("v").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"))
    outside = own.join(shares, "v").filter("comp <> most")
    other = own.select("v", *[F.col(c).alias(f"r_{c}") for c in own.columns if c != "v"])
    n, m = F.col("n"), F.col("r_n")
    lacks = lambda size, pos: (size - pos) * (100 + percent) >= (n + m) * percent
    first = ((F.col("top") > F.col("r_top")) | lacks(n, F.col("pos"))) & ((F.col("r_top") > F.col("top")) | lacks(m, F.col("r_pos")))
    once = (F.col("r_comp") == F.col("most")) | (F.col("node") < F.col("r_node"))
    met_before = reduce(or_, [F.coalesce(F.col(f"p{i}") == F.col(f"r_p{j}"), F.lit(False)) for i in range(PRIOR) for j in range(PRIOR)])
    met = outside.join(other, "v").filter(once & (F.col("comp") != F.col("r_comp")) & first & ~met_before & _enough("", "r_", percent, shared))
    return met.select(*_ordered("node", "r_node")).distinct()


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, k: int = K, shared: int = SHARED) -> DataFrame:
    """One row for each row of ``df``: id, n_shingles, component_id (smallest id reachable over links), kept."""
    sketched = written(sketches(df, id_col, text_col, width, k, percent), "sketches")
    grouped = sketched.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.coalesce(F.min_by("th", "id"), F.min("th")).alias("th"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("whole").alias("whole"), F.first("part").alias("part"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    bits = [F.col(c)[i].alias(p) for c, names in (("whole", _WHOLE), ("part", _SKETCH)) for i, p in enumerate(names)]
    bitmaps = classes.select("node", "n", F.size("sketch").alias("held"), F.when(F.col("n") > k, F.array_max("sketch")).otherwise((1 << 63) - 1).alias("top"), *bits)
    rows = written(sketched.select("id", "n", "digest"), "rows")
    deleted(sketched)
    freed(df.sparkSession)

    # Inverted lists of the rarest retained values.
    entries = classes.select("node", F.explode("sketch").alias("v"))
    frequent = written(entries.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    freed(df.sparkSession)
    ranked = entries.join(frequent, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("rare"))  # at most k
    ranked = ranked.join(classes.select("node", "n", F.size("sketch").alias("held")), "node")
    alone = F.col("held") - F.size("rare")  # values of its own come first, and meet nothing
    room = F.col("held") - least_shared(F.col("n"), k, shared, percent) + 1 - alone
    index = ranked.withColumn("room", room.cast("int")).filter("room > 0").select("node", "n", alone.alias("alone"), F.posexplode(F.slice("rare", F.lit(1), F.col("room"))).alias("pos", "e"))
    index = written(index.select("node", "n", (F.col("pos") + F.col("alone")).alias("pos"), "e.v"), "index")
    deleted(frequent)
    freed(df.sparkSession)

    def with_sets(sets: DataFrame | None, nodes: DataFrame) -> DataFrame:
        """``sets`` and those of ``nodes`` that it lacks."""
        lacking = nodes if sets is None else nodes.join(sets.select("node"), "node", "left_anti")
        wanted = written(lacking.join(classes.select("node", "id", "th"), "node"), "wanted")
        if sets is not None and wanted.isEmpty():
            return sets
        new = written(full_sets(df, wanted, id_col, text_col, width), "sets")
        return new if sets is None else sets.union(new)

    state, held = index.withColumn("comp", F.col("node")), index
    sets, comps = None, None
    for round_, stars in enumerate([*STARS, 0]):
        if round_:
            # a list of two classes is done: one was a centre in the first round
            split = state.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).filter("x <> y AND c > 2").select("v")
            state = written(state.join(split, "v", "left_semi"), "open")
            deleted(held)
            held = state
        if stars:
            pairs = allowed_pairs(_star_pairs(state, stars, f"{round_}|", percent), bitmaps, percent, shared)
        else:
            pairs = list_pairs(state, bitmaps, percent, shared)
        likely = likely_pairs(pairs, classes, k, shared)
        freed(df.sparkSession)
        sets = with_sets(sets, ends_of(likely))
        freed(df.sparkSession)
        links = verified(likely, sets, percent)
        freed(df.sparkSession)
        if links.isEmpty():
            continue
        if comps is None:
            comps = components(links)
        else:  # links between components join these
            of = lambda x: comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
            named = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            moved = components(named.filter("a <> b")).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            alone = ends_of(links).join(comps.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
            comps = written(comps.unionByName(alone).join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")
        if stars:
            state = state.drop("comp").join(comps, "node", "left").select("node", "n", "pos", "v", F.coalesce("comp", "node").alias("comp"))
            state = written(state, "state")
            deleted(held)
            held = state
            freed(df.sparkSession)
    if comps is None:
        comps = classes.select("node", F.col("node").alias("comp"))
    comp = F.coalesce("comp", "node")

    # Back to the rows.
    named = classes.select("node", "digest", "id").join(comps, "node", "left").select("digest", "id", comp.alias("comp"))
    smallest = written(named.groupBy("comp").agg(F.min("id").alias("component_id")), "smallest")
    named = written(named.join(smallest, "comp").select("digest", "component_id"), "named")
    out = rows.join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``df`` with one document of each group: the one of the smallest id; columns as they are. Ids are unique, as
    they are after exact deduplication."""
    (key,) = unused(df, "_dropped_id")
    dropped = near_groups(df, id_col, text_col, **how).filter("not kept").select(F.col(id_col).alias(key)).distinct()
    return df.join(dropped, F.col(id_col) == F.col(key), "left_anti")


def op9_minhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"), width=2)
