"""Training triplets and evaluation queries: splits, held-out aliases, hard negatives.

Splits and hold-outs are drawn by md5 of seed and entity_id, so they do not depend on order or
partitioning.  ``parity_split`` draws the permutation on the driver by Python's generator, for
catalogues whose earlier splits have to be reproduced.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameloom.functions.text import canonical_name, first_token, with_folded, with_normalized
from nameloom.operators.names import unique_names
from nameloom.operators.order import ordinal_cell, positions
from nameloom.sources.shared import written


def _draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def split_entities(entities: DataFrame, eval_ratio: float = 0.2, seed: int = 13) -> DataFrame:
    """``entities`` with split_ord (shuffled position) and is_eval: the first max(1, rint(n * ratio)) are for evaluation."""
    n = entities.count()
    size = max(1, round(n * eval_ratio)) if n else 0
    drawn = entities.withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("entity_id"))))
    placed = positions(drawn, F.substring("_draw", 1, 4), ["_draw", "ent_ord"], "split_ord").drop("_draw")
    return placed.withColumn("is_eval", F.col("split_ord") < size)


def parity_split(entities: DataFrame, eval_ratio: float = 0.2, seed: int = 13, limit: int = 1_000_000) -> DataFrame:
    """The same columns from Python's seeded shuffle of the catalogue's positions (at most ``limit`` entities)."""
    n = entities.count()
    if n > limit:
        raise ValueError(f"a driver-side permutation is for up to {limit} entities")
    places = list(range(n))
    random.Random(seed).shuffle(places)
    size = max(1, round(n * eval_ratio)) if n else 0
    drawn = entities.sparkSession.createDataFrame([(p, i) for i, p in enumerate(places)], "_at long, split_ord long")
    return positions(entities, ordinal_cell("ent_ord"), ["ent_ord"], "_at").join(drawn, "_at").drop("_at").withColumn("is_eval", F.col("split_ord") < size)


def _norm_canonical(entities: DataFrame) -> DataFrame:
    """(ent_ord, canonical, canonical_norm)."""
    return with_normalized(entities.select("ent_ord", canonical_name().alias("canonical")), "canonical", "canonical_norm")


def alias_holdouts(train: DataFrame, ratio: float = 0.4, seed: int = 13) -> DataFrame:
    """(entity_id, ent_ord, heldout, heldout_norm): the last name that is not the canonical one, for a hashed share of entities with three names."""
    named = _named(train, "holdout-names")
    other = F.col("norm") != F.col("canonical_norm")
    rows = named.groupBy("ent_ord", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("name", "norm"), F.when(other, F.col("name_ord"))).alias("last"), F.count_if(other).alias("others"))
    chosen = rows.where((F.col("n") >= 3) & (F.col("others") >= 1)).where(_draw(seed + 17, F.col("entity_id")) < ratio)
    return chosen.select("entity_id", "ent_ord", F.col("last.name").alias("heldout"), F.col("last.norm").alias("heldout_norm"))


def _firsts(rows: DataFrame) -> DataFrame:
    """(kind, key, one_id, one, two): per group the canonical name of its first row, and of its first row with another entity_id.

    ``rows``: (ent_ord, entity_id, canonical, kind, key).  Rows are reduced to one per group and id, of these to two per group
    (on the map side already), so a group that holds every entity costs no more than another.
    """
    ids = rows.groupBy("kind", "key", "entity_id").agg(F.min(F.struct("ent_ord", "canonical")).alias("f"))
    order = Window.partitionBy("kind", "key").orderBy("f.ent_ord")
    two = ids.withColumn("n", F.row_number().over(order)).where("n <= 2")
    value = lambda n, c: F.max(F.when(F.col("n") == n, F.col(c)))
    return two.groupBy("kind", "key").agg(value(1, "entity_id").alias("one_id"), value(1, "f.canonical").alias("one"), value(2, "f.canonical").alias("two"))


def hard_negatives(train: DataFrame) -> DataFrame:
    """(ent_ord, entity_id, canonical, hard_negative): first other of the genus, else of the rank, else of all, else itself."""
    rows = train.select("ent_ord", "entity_id", "taxon_rank", canonical_name().alias("canonical"), first_token(F.col("scientific_name")).alias("_first"))
    rows = written(with_folded(rows, "_first", "genus").drop("_first"), "negatives")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("genus", F.col("genus")), ("rank", F.col("taxon_rank")), ("any", F.lit("")))])
    heads = written(_firsts(rows.select("ent_ord", "entity_id", "canonical", F.inline(kinds))), "negative-heads")
    for kind, key in (("genus", F.col("genus")), ("rank", F.col("taxon_rank")), ("any", F.lit(""))):
        head = heads.where(F.col("kind") == kind).select(F.col("key").alias("_key"), "one_id", "one", "two")
        rows = rows.join(head, key.eqNullSafe(F.col("_key")), "left")
        rows = rows.withColumn(f"by_{kind}", F.when(F.col("entity_id") != F.col("one_id"), F.col("one")).otherwise(F.col("two"))).drop("_key", "one_id", "one", "two")
    return rows.select("ent_ord", "entity_id", "canonical", F.coalesce("by_genus", "by_rank", "by_any", "canonical").alias("hard_negative"))


def _named(entities: DataFrame, name: str) -> DataFrame:
    """Unique names with their entity's canonical one, computed once."""
    return written(unique_names(entities).join(_norm_canonical(entities), "ent_ord"), name)


def training_triplets(train: DataFrame, holdouts: DataFrame, max_pairs: int = 8) -> DataFrame:
    """(ent_ord, name_ord, anchor, positive, hard_negative, entity_id); ``train`` is in the order of ent_ord."""
    named = _named(train, "training-names").join(holdouts.select("entity_id", "heldout_norm"), "entity_id", "left")
    named = named.where(F.col("heldout_norm").isNull() | (F.col("norm") != F.col("heldout_norm")))
    each = Window.partitionBy("ent_ord")
    named = named.withColumn("left_ord", F.row_number().over(each.orderBy("name_ord")) - 1).withColumn("is_anchor", F.col("norm") != F.col("canonical_norm"))
    named = named.withColumn("anchors", F.count_if("is_anchor").over(each))
    anchors = named.where(F.col("is_anchor") | ((F.col("anchors") == 0) & (F.col("left_ord") == 1)))
    anchors = anchors.withColumn("place", F.row_number().over(each.orderBy("name_ord"))).where(F.col("place") <= max_pairs)
    negative = with_normalized(hard_negatives(train).select("ent_ord", "hard_negative"), "hard_negative", "negative_norm")
    rows = anchors.join(negative, "ent_ord")
    once = Window.partitionBy("norm", "canonical_norm", "negative_norm").orderBy("ent_ord", "name_ord")
    rows = rows.withColumn("seen", F.row_number().over(once)).where("seen = 1")
    return rows.select("ent_ord", "name_ord", F.col("name").alias("anchor"), F.col("canonical").alias("positive"), "hard_negative", "entity_id")


def evaluation_queries(train: DataFrame, held_entities: DataFrame, holdouts: DataFrame, max_queries: int = 4) -> DataFrame:
    """(query, target_entity_id, target_name, split): held-out aliases, and names of held-out entities."""
    aliases = holdouts.join(train.select("ent_ord", canonical_name().alias("canonical")), "ent_ord").select(F.col("heldout").alias("query"), F.col("entity_id").alias("target_entity_id"), F.col("canonical").alias("target_name"), F.lit("alias").alias("split"))
    named = _named(held_entities, "evaluation-names")
    each = Window.partitionBy("ent_ord")
    named = named.withColumn("other", F.col("norm") != F.col("canonical_norm"))
    named = named.withColumn("others", F.count_if("other").over(each)).where(F.col("other") | ((F.col("others") == 0) & (F.col("name_ord") == 0)))
    named = named.withColumn("place", F.row_number().over(each.orderBy("name_ord"))).where(F.col("place") <= max_queries)
    entities = named.select(F.col("name").alias("query"), F.col("entity_id").alias("target_entity_id"), F.col("canonical").alias("target_name"), F.lit("entity").alias("split"))
    return aliases.unionByName(entities)
