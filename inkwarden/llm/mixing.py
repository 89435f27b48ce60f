"""Mixing sources to target weights by capped water-filling.

Every source has a weight. The corpus size is shared by weight; a source is
clamped at ``max_epochs`` times its own size and what it cannot use goes to the
others by weight, until none is above its cap. With the sources ordered by
cap / weight that fixed point has a closed form: the level is the largest
(rest of the total) / (rest of the weights) over the prefixes of clamped
sources, and a source gets ``least(cap, weight * level)``.

The documents of a source are read in a seeded order. Each is taken whole
``floor(target / size)`` times, and those in front of the cut once more; the
document on the cut gives the first words that are still wanted. Prefix sums
are taken over 4096 hash buckets first, so that a window sees only the rows of
the one bucket on the cut, whatever a source's share of the corpus is.

Cases: null text or text without a word has size 0 and takes 0; a very long text
is a document like any other, and may lie on the cut; a null source is a source
of its own, last in order; null ids are ordered as '', and by size among themselves; an empty table gives an
empty result; a repeated row is a document like any other, and rows with one id
and size may stand for each other; columns of ``docs`` are boxed, so their names
clash with nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, cut_lineage, key_of, n_words, small, unboxed

BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(_src, _key, _source_size) to the same rows with ``_target`` (double) and ``_goal`` (long).

    One row per source, so the global windows here see as many rows as there are sources.
    """
    order = Window.orderBy(F.col("_src").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sizes.withColumn("_rank", F.row_number().over(order) - 1).withColumn("_w", weight).withColumn("_cap", F.col("_source_size") * max_epochs)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy((F.col("_cap").cast("double") / F.col("_w")), F.col("_rank")).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_left", F.sum("_source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    s = s.withColumn("_w_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    s = s.withColumn("_level", F.max(F.col("_left").cast("double") / F.col("_w_left")).over(every))
    s = s.withColumn("_target", F.least(F.col("_cap").cast("double"), F.col("_w") * F.col("_level")))
    return s.withColumn("_goal", F.least(F.col("_cap"), F.floor(F.col("_target") + 0.5).cast("long"))).select("_src", "_key", "_source_size", "_target", "_goal")


def _place(id_col: str, seed: int) -> Column:
    """A document's place in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _bucket(id_col: str, seed: int, u: Column, size: Column) -> Column:
    """One of 4096 parts of the order; rows without an id, which have one place, are parts by their size."""
    nowhere = hashlib.md5(f"{seed}|".encode(), usedforsecurity=False).hexdigest()
    side = F.when(F.col(id_col).isNull(), F.concat(F.lit("0"), F.lpad(size.cast("string"), 19, "0"))).when(u < nowhere, " ").otherwise("~")
    return F.concat(F.substring(u, 1, 3), F.when(F.substring(u, 1, 3) == nowhere[:3], side).otherwise(""))


def measured(docs: DataFrame, row: Column, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """_row (what is carried along), _src, _key, _size, _u (place in the seeded order) and _b (its bucket) for each row of ``docs``."""
    rows = docs.select(row.alias("_row"), F.col(source_col).alias("_src"), key_of(source_col).alias("_key"), n_words(F.col(text_col)).alias("_size"), _place(id_col, seed).alias("_u"), F.col(id_col).alias("_id"))
    return rows.withColumn("_b", _bucket("_id", seed, F.col("_u"), F.col("_size"))).drop("_id")


def _plan(rows: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """A row for each source of ``rows`` as of :func:`measured`: _key, _source_size, _target, _repeats, and the bucket _cut in which the last _cut_rest words are taken."""
    buckets = rows.groupBy("_key", "_b").agg(F.first("_src").alias("_src"), F.sum("_size").alias("_n"))
    sizes = buckets.groupBy("_key").agg(F.first("_src").alias("_src"), F.sum("_n").alias("_source_size"))
    plan = source_targets(sizes, weights, max_epochs)
    whole = F.when(F.col("_source_size") > 0, F.expr("_goal div _source_size")).otherwise(F.lit(0).cast("long"))
    plan = plan.withColumn("_repeats", whole).withColumn("_rest", F.col("_goal") - F.col("_repeats") * F.col("_source_size"))
    up_to = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = buckets.withColumn("_end", F.sum("_n").over(up_to)).join(plan.select("_key", "_rest"), "_key").filter("_end - _n <= _rest AND _end > _rest")
    cuts = placed.select("_key", F.col("_b").alias("_cut"), (F.col("_rest") - (F.col("_end") - F.col("_n"))).alias("_cut_rest"))
    return small(plan.join(cuts, "_key", "left").drop("_src", "_rest", "_goal"), BROADCAST_SOURCES)


def _edge(rows: DataFrame) -> DataFrame:
    """_extra for the rows of a cut bucket: the words of it that are still wanted."""
    before = Window.partitionBy("_key").orderBy("_u", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return rows.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_cut_rest") - F.col("_before"))).cast("long")).drop("_before")


def mix(rows: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``rows`` as of :func:`measured` with _source_size, _target, _repeats (long) and _extra (long, words of one more, maybe partial, repeat)."""
    rows = rows.join(_plan(rows, weights, max_epochs), "_key")
    # A source without a cut bucket has nothing left over after its whole repeats.
    sure = rows.filter("_cut IS NULL OR _b <> _cut").withColumn("_extra", F.expr("CASE WHEN _b < _cut THEN _size ELSE 0 END").cast("long"))
    return sure.unionByName(_edge(rows.filter("_b = _cut"))).drop("_cut", "_cut_rest")


def repeated(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mix as rows: each document as often as it is taken, a partial repeat rounded to none or one.

    Words are counted once, for the plan; after that only the rows of cut buckets are counted again.
    """
    counted = cut_lineage(measured(docs, F.lit(None).cast("string"), id_col, text_col, source_col, seed).drop("_row", "_u"))
    rows = docs.select(boxed(docs), key_of(source_col).alias("_key"), F.col(text_col).alias("_text"), _place(id_col, seed).alias("_u"), F.col(id_col).alias("_id"))
    rows = rows.withColumn("_b", _bucket("_id", seed, F.col("_u"), n_words(F.col("_text")))).drop("_id")
    rows = rows.filter(F.rlike("_text", F.lit(WORD))).join(_plan(counted, weights, max_epochs), "_key")
    sure = rows.filter("_cut IS NULL OR _b <> _cut").withColumn("_more", F.expr("CASE WHEN _b < _cut THEN 1 ELSE 0 END"))
    edge = _edge(rows.filter("_b = _cut").withColumn("_size", n_words(F.col("_text")))).withColumn("_more", F.when(F.col("_extra") * 2 >= F.col("_size"), 1).otherwise(0))
    cols = ["_row", (F.col("_repeats") + F.col("_more")).cast("int").alias("_times")]
    times = sure.select(*cols).unionByName(edge.select(*cols)).filter("_times > 0")
    return unboxed(times.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs.columns)
