"""Queries as a stream (an extension: the cascade in micro-batches against a static index).

Alias and abbreviation hits are stateless stream-static joins; the ranked vector stage
needs whole batches, so the cascade runs in ``foreachBatch`` and each batch's results
are appended with its number, which makes a repeated batch recognisable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nameloom.functions.text import normalize_ascii
from nameloom.operators.cascade import THRESHOLD, TOP_K, Index, alias_hits, retrieve


def exact_stream(queries: DataFrame, index: Index) -> DataFrame:
    """Alias hits of a stream of ASCII queries (qid, query), as a stateless join."""
    return alias_hits(queries.withColumn("norm", normalize_ascii(F.col("query"))), index.aliases)


def resolve_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, top_k: int = TOP_K, threshold: float = THRESHOLD, **trigger) -> StreamingQuery:
    """Run the cascade on each micro-batch of ``queries`` (qid, query) and hand (results, batch number) to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        sink(retrieve(rows.select("qid", "query"), index, top_k, threshold).withColumn("batch", F.lit(number)), number)
        rows.unpersist()

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
