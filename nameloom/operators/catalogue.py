"""Catalogue construction: paged scans, candidates, first-wins dedupe, merge and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameloom.functions import html
from nameloom.functions.text import abbreviated_aliases, numeric_suffix, rank_of, with_folded
from nameloom.operators.order import ordinal_cell, positions
from nameloom.sources.shared import written

DETAIL_URL = "https://www.china-cicc.org/cicc/detail/?cid="


def pages_before_stop(counts: DataFrame, stop_after: int = 2) -> DataFrame:
    """``counts`` (category, page_no, n): the pages read before ``stop_after`` empty ones in a row end a category."""
    order = Window.partitionBy("category").orderBy("page_no")
    empty = F.count_if(F.col("n") == 0).over(order.rowsBetween(-(stop_after - 1), 0)) == stop_after
    rows = counts.withColumn("_stop", empty)
    earlier = F.coalesce(F.max(F.col("_stop").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_earlier", earlier).where("_earlier = 0").drop("_stop", "_earlier")


def make_candidates(found: DataFrame) -> DataFrame:
    """Entities without id from (ord, url, category, cn, latin, cid, strain)."""
    return found.select(
        "ord", F.col("cn").alias("standard_name_cn"), F.col("latin").alias("scientific_name"), rank_of(F.col("latin")).alias("taxon_rank"),
        abbreviated_aliases(F.col("latin")).alias("aliases"), F.array().cast("array<string>").alias("former_names"),
        F.struct(F.lit("CICC").alias("source"), F.col("url").alias("source_page"), "category", F.concat(F.lit(DETAIL_URL), "cid").alias("detail_url"), F.when(F.col("strain").isNotNull(), F.array("strain")).alias("strain_examples")).alias("metadata"),
    )


def first_wins(candidates: DataFrame, key: str = "scientific_name") -> DataFrame:
    """The first candidate (by ord) of each case-folded key."""
    rows = with_folded(candidates, key, "_k").groupBy("_k").agg(F.min_by(F.struct(*candidates.columns), "ord").alias("_f"))
    return rows.select("_f.*")


def source_examples(candidates: DataFrame, key: str = "scientific_name") -> DataFrame:
    """(key, url, examples) per case-folded key: the later sightings' (category, url), the first of each url, in order."""
    seen = with_folded(candidates.select(key, "ord", "category", "url"), key, "k")
    firsts = seen.groupBy("k").agg(F.min("ord").alias("first_ord"))
    later = seen.select("k", "ord", "category", "url").join(firsts, "k").where((F.col("ord") > F.col("first_ord")) & F.col("url").isNotNull() & (F.col("url") != ""))
    once = later.groupBy("k", "url").agg(F.min_by("category", "ord").alias("category"), F.min("ord").alias("ord"))
    return once.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "category", "url"))), lambda e: F.struct(F.lit("CICC").alias("source"), e["category"].alias("category"), e["url"].alias("url"))).alias("examples"))


def numbered(rows: DataFrame, order: str, start: int, pattern: str, out: str = "entity_id") -> DataFrame:
    """Add ``out``: ids in the order of ``order`` (a whole number), from ``start``."""
    placed = positions(rows, ordinal_cell(order), [order], "_n")
    return placed.withColumn(out, F.format_string(pattern, F.col("_n") + start)).drop("_n")


def next_id(base: DataFrame) -> int:
    return base.agg(F.coalesce(F.max(numeric_suffix(F.col("entity_id"))), F.lit(0)) + 1).first()[0]


def merge(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ord, is_new, entity_id, scientific_name): base rows, then candidates whose name is new, with the next ids.

    Names are compared case-folded and otherwise as they are; repeats within the base stay.
    """
    known = with_folded(base.select("scientific_name"), "scientific_name", "_k").select("_k").distinct()
    fresh = first_wins(with_folded(candidates, "scientific_name", "_k").join(known, "_k", "left_anti").drop("_k"))
    fresh = numbered(fresh.drop("entity_id"), "ord", next_id(base), "TAXON:%04d")
    columns = ("ord", "is_new", "entity_id", "scientific_name")
    return base.withColumn("is_new", F.lit(False)).select(*columns).unionByName(fresh.withColumn("is_new", F.lit(True)).select(*columns))


def _sightings(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidates (ord, url, category, cn, latin, cid, strain) of ``pages`` named in ``listed`` (url, category, place)."""
    found = html.page_candidates(pages.join(listed.select("url"), "url", "left_semi")).join(listed, "url")
    return found.select((F.shiftleft(F.col("place").cast("long"), 32) + F.col("row_ord")).alias("ord"), "page_id", "url", "category", "cn", "latin", "cid", "strain")


def crawl(pages: DataFrame, start_url: str, max_pages: int = 20) -> DataFrame:
    """Entities (with ids CICC_TAXON:00001 on) from fetched ``pages`` (page_id, url, html), each url once.

    If the start page lists recommendations, those pages are read, and later sightings of a name become its
    ``source_examples``.  Else category pages are read in order of url, each up to ``max_pages`` pages or two empty ones in a row
    (a page that was not fetched counts as empty).  The first sighting of a case-folded name wins.
    """
    found = written(html.links(pages.where(F.col("url") == start_url)), "start-links")
    listed = html.recommendation_urls(found)
    if not listed.isEmpty():
        place = positions(listed, F.lit(""), ["url"], "place")  # the lists of one page
        seen = written(_sightings(pages, place.withColumnRenamed("label", "category")), "sightings")
        named = seen.withColumnRenamed("latin", "scientific_name")
        made = first_wins(make_candidates(seen))
        made = with_folded(made, "scientific_name", "_k").join(source_examples(named).withColumnRenamed("k", "_k"), "_k", "left").drop("_k")
    else:
        starts = positions(html.category_urls(found, start_url), F.lit(""), ["url"], "category_no").withColumnRenamed("url", "category")
        grid = starts.select("category", "category_no", F.explode(F.sequence(F.lit(0), F.lit(max_pages - 1))).alias("page_no"))
        grid = written(grid.withColumn("url", html.page_urls("category", "page_no")), "category-pages")
        seen = _sightings(pages, grid.select("url", F.lit(None).cast("string").alias("category"), (F.col("category_no") * max_pages + F.col("page_no")).alias("place")))
        seen = written(seen, "sightings")
        counts = grid.join(seen.groupBy("url").agg(F.count(F.lit(1)).alias("n")), "url", "left").na.fill(0, ["n"])
        read = pages_before_stop(counts.select("category", "page_no", "n", "url"))
        made = first_wins(make_candidates(seen.join(read.select("url"), "url", "left_semi"))).withColumn("examples", F.lit(None).cast("array<struct<source: string, category: string, url: string>>"))
    made = made.withColumn("metadata", F.col("metadata").withField("source_examples", F.col("examples"))).drop("examples")
    return numbered(made, "ord", 1, "CICC_TAXON:%05d")
