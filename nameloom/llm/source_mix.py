"""Mixing sources to target weights, to the word, with hash-random order.

Targets.  Sources by code point (null last) get ``weights`` in turn and share
``share`` times the words of all documents; a source stops at ``epochs`` times
its own words, and the excess goes to the others by weight until none is above.
That fixed point is a water level: target = min(cap, weight * level), found with
two windows over one row per source.

Selection.  A target of e whole epochs and a rest takes every document e times.
For the rest, documents get hash-random keys, are range-sorted by key within
their source, and distributed prefix sums of the sizes (``common.prefix_sums``)
show where the budget ends; the document there gives just the words missing.

Cases: null text has size 0; null source is a source of its own; null or
repeated doc_ids are rows like any other (rows without an id are ordered by a hash of the whole row; equal rows are
interchangeable; ties of the key go by doc_id, size and row); a very long text is one row like any other; an empty table gives an empty result; a source
without words has target 0; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameloom.llm.common import KEY_BITS, WORD, bucket_bits, hash_key, materialise, n_words, packed, prefix_sums, words

SEED = "mix-1"
WEIGHTS = (5, 2, 1)


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): one row per source."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    cap = (F.col("source_size") * epochs).cast("double")
    rows = sums.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("_cap", cap)
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    rows = rows.withColumn("_level", level)
    open_ = F.col("_cap") > F.col("_w") * F.col("_level")
    rows = rows.withColumn("_open", open_).withColumn("_last", F.max(F.when(F.col("_open"), F.col("_level"))).over(every))
    return rows.select("source", "source_size", F.when(F.col("_open"), F.col("_w") * F.col("_last")).otherwise(F.col("_cap")).alias("target"))


def row_key(docs: DataFrame) -> Column:
    """Hash of a whole row: rows with equal keys are equal."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def order_key(doc_id: Column, row: Column, seed: str) -> Column:
    """Hash-random key of a row; rows without an id have keys of their own."""
    return hash_key(F.coalesce(doc_id.cast("string"), F.concat(F.lit("row "), row.cast("string"))), seed=seed)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2, seed: str = SEED) -> DataFrame:
    """doc_id, source, row (hash of the whole row), key (its place in the order), size, source_size, target, whole (epochs), taken: words the mix takes of each row of ``docs``."""
    sized = materialise(docs.select("doc_id", "source", row_key(docs).alias("row"), n_words(F.col("text")).alias("size")), "mix-sizes")
    bits = bucket_bits(sized.count())
    targets = source_targets(sized, weights, share, epochs)
    # one narrow row per source; its name is replaced by its number so that later keys are never null
    numbered = targets.withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumnRenamed("source", "_name")
    numbered = materialise(numbered, "mix-targets")
    keyed = sized.join(numbered, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    keyed = keyed.withColumn("_key", order_key(F.col("doc_id"), F.col("row"), seed)).withColumn("_bucket", F.shiftright("_key", KEY_BITS - bits) if bits else F.lit(0).cast("long"))
    summed = prefix_sums(keyed, ["_s"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("row")], "size", "_before")
    budget = F.round(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(budget - whole * F.col("source_size") - F.col("_before"), F.lit(0).cast("long"))
    return summed.select("doc_id", "source", "row", F.col("_key").alias("key"), "size", "source_size", "target", whole.alias("whole"), (whole * F.col("size") + F.least(rest, F.col("size"))).cast("long").alias("taken"))


#: Copies of a row that are made from one array.
COPIES = 1_000


def source_edges(mixed: DataFrame) -> DataFrame:
    """One row per source: _whole epochs, _edge (the last place that the rest reaches, null if there is no rest), _extra words of the _m equal rows there."""
    rows = materialise(mixed.where("size > 0").select("source", "whole", F.struct("key", "doc_id", "size", "row").alias("place"), (F.col("taken") - F.col("whole") * F.col("size")).alias("extra")), "mix-places")
    ends = materialise(rows.groupBy(F.col("source").alias("_name")).agg(F.max("whole").alias("_whole"), F.max(F.when(F.col("extra") > 0, F.col("place"))).alias("_edge")), "mix-ends")
    there = rows.join(ends, F.col("source").eqNullSafe(F.col("_name")) & (F.col("place") == F.col("_edge")))
    there = there.groupBy(F.col("source").alias("_at")).agg(F.sum("extra").alias("_extra"), F.count(F.lit(1)).alias("_m"))
    return materialise(ends.join(there, F.col("_name").eqNullSafe(F.col("_at")), "left").drop("_at"), "mix-edges")


def apply_mix(docs: DataFrame, mixed: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: repeats whole, the document at a budget's end cut.

    A document with ``taken`` = c * size + k comes c times, and, if k > 0, once
    more with its first k words joined by single spaces.  ``mixed`` is ``mix`` of the same ``docs`` and ``seed``.
    A row's place in its source's order follows from the row itself, so documents meet one row per source and are not shuffled;
    only the rows at an edge, which are equal, are gathered, and one of them comes as often as all of them should.
    """
    edges = source_edges(mixed)
    rows = packed(docs, "text", F.col("source").alias("_source"), F.col("doc_id").alias("_id"), row_key(docs).alias("_row"))
    rows = rows.where(F.col("text").rlike(WORD)).withColumn("_key", order_key(F.col("_id"), F.col("_row"), seed))
    rows = rows.join(edges, F.col("_source").eqNullSafe(F.col("_name")))
    place = F.struct(F.col("_key").alias("key"), F.col("_id").alias("doc_id"), n_words(F.col("text")).alias("size"), F.col("_row").alias("row"))
    tie = F.col("_key") == F.col("_edge.key")  # words are counted for these rows only
    at_edge = F.coalesce(F.when(tie, place == F.col("_edge")), F.lit(False))
    before = F.coalesce((F.col("_key") < F.col("_edge.key")) | F.when(tie, place < F.col("_edge")), F.lit(False))
    none = F.array().cast("array<int>")
    plain = rows.where(~at_edge).select("_doc", "text", (F.col("_whole") + before.cast("long")).alias("_copies"), none.alias("_rest")).where("_copies > 0")
    kept = ("_doc", "text", "_whole", "_edge", "_extra", "_m")
    ends = rows.where(at_edge).groupBy("_row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in kept])
    part = F.expr("cast(_extra % _edge.size as int)")
    ends = ends.select("_doc", "text", F.expr("_m * _whole + _extra div _edge.size").alias("_copies"), F.when(part > 0, F.array(part)).otherwise(none).alias("_rest"))
    rows = plain.unionByName(ends)
    # fields under numbers: extraction from a struct is not resolved through two generators
    rows = rows.select("text", "_copies", "_rest", *[F.col("_doc").getField(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    rows = rows.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_copies div {COPIES}"))))
    here = F.least(F.lit(COPIES), F.col("_copies") - F.col("_lot") * COPIES).cast("int")
    rows = rows.withColumn("_part", F.explode(F.concat(F.array_repeat(F.lit(0), here), F.when(F.col("_lot") == 0, F.col("_rest")).otherwise(F.array().cast("array<int>")))))
    shortened = F.col("_part") > 0
    cut = F.array_join(F.slice(words(F.col("text")), 1, F.greatest(F.col("_part"), F.lit(1))), " ")
    text = F.when(shortened, cut).otherwise(F.col("text"))
    out = {c: F.col(f"c{i}") for i, c in enumerate(docs.columns)} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.when(shortened, F.length(text).cast("long")).otherwise(out["n_chars"])
    return rows.select(*[x.alias(c) for c, x in out.items()])
