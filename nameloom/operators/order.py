"""Positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, cell: Column, order: list, out: str) -> DataFrame:
    """Add ``out``: each row's place from 0 in the order of ``cell`` and then ``order``.

    Only the rows of one cell are sorted together; cells, one row each, are summed in a second, small window.
    """
    keyed = df.withColumn("_cell", cell)
    sizes = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = keyed.withColumn("_place", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)) - 1)
    return inside.join(bases, "_cell").withColumn(out, (F.col("_base") + F.col("_place")).cast("long")).drop("_cell", "_place", "_base")


def ordinal_cell(ordinal: str) -> Column:
    """Cells of at most 2**17 consecutive values of a whole number that orders rows."""
    return F.shiftright(F.col(ordinal).cast("long"), 17)
