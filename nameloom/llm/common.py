"""What the operators of this subpackage share: words, tables, shared folder, prefix sums."""

from __future__ import annotations

import atexit
import itertools
import math
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """All words of a text in order; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="nameloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """URI of a folder that the driver and all executors see.

    It is the one in ``spark.checkpoint.dir``.  Only a session in local mode may
    leave that unset; a temporary folder of this process serves then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return _own_folder()
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    hadoop = spark._jsc.hadoopConfiguration()
    uri = path.getFileSystem(hadoop).makeQualified(path).toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/nameloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again.

    Later jobs start from the files: nothing is computed twice, and a lost
    executor costs no more than the tasks it was running.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker, unless the session has a limit of its own.
ARROW_BYTES = "16m"


def limit_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold about ``ARROW_BYTES``, if it sets no limit itself.

    A batch lies in the JVM and in the worker at once, for each running task, in buffers of up to twice its size.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)


def packed(docs: DataFrame, *names: str | Column) -> DataFrame:
    """The columns ``names`` and the whole row as ``_doc``, so that no other column can clash with a working name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *names)


def unpacked(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The row in ``_doc`` again, with new values for those of its columns that are given."""
    return df.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in names])


def hash_key(*parts: Column | str, seed: str) -> Column:
    """60 hash bits of ``parts`` as a non-negative long, the same in any engine that has md5."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce((p if isinstance(p, Column) else F.col(p)).cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


KEY_BITS = 60


def bucket_bits(rows: int, per_bucket: int = 2_000) -> int:
    """Bits that split ``rows`` hash-random keys into buckets of about ``per_bucket``."""
    return max(0, min(30, math.ceil(math.log2(max(1, rows) / per_bucket)))) if rows > per_bucket else 0


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys`` that come before.

    Rows are ordered by ``bucket`` (any orderable column computed from the row)
    and then by ``order``.  Only one (keys, bucket) cell is ever sorted in one
    task; the cells' own totals, one row each, are summed in a second, small
    window.  So a key that holds a third of all rows costs no more than another.
    """
    cell = [*keys, bucket]
    totals = df.groupBy(*cell).agg(F.sum(value).alias("_cell_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_cell_base", F.coalesce(F.sum("_cell_sum").over(before), F.lit(0).cast("long"))).drop("_cell_sum")
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0).cast("long")))
    return local.join(totals, cell).withColumn(out, (F.col("_cell_base") + F.col("_inside")).cast("long")).drop("_cell_base", "_inside")


#: Up to so many ids are sent to every executor instead of shuffling the table they select from.
BROADCAST_IDS = 500_000


def by_ids(df: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """``df`` semi- or anti-joined to the distinct values of ``ids``, whose size decides how.

    ``ids`` should be a table that is cheap to read.  Up to ``BROADCAST_IDS`` rows
    it is broadcast, so ``df`` stays in place; beyond that both are shuffled.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, on, how)


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(v, label) for every end of ``links`` (a, b): label is the smallest end in its component.

    Every link is kept as (larger end, smaller end), and alternating stars shorten the paths: first each
    link's smaller end gives way to its own smallest neighbour, then the smaller ends of a vertex are linked
    to the smallest of them.  The number of rounds grows with the logarithm of a component's size, whatever
    the ids; rounds go on until one changes nothing.  Links are written to the
    shared folder after each step; only the counts of changes come to the driver.  A hub is many rows of one side of a join
    whose other side has one row per vertex, so adaptive execution can split it.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = materialise(ends, f"{name}-links")
    alone, links = ends.where("a = b").select("a", "b"), ends.where("a > b")
    parents = lambda e: e.groupBy(F.col("a").alias("_v")).agg(F.min("b").alias("_p"))
    for turn in itertools.count():
        near = links.join(parents(links), F.col("b") == F.col("_v"), "left").select("a", F.coalesce("_p", "b").alias("b"), (F.col("_p") < F.col("b")).alias("moved"))
        near = materialise(near.groupBy("a", "b").agg(F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved")), f"{name}-near-{turn}")
        many = near.groupBy("a").agg(F.min("b").alias("_p"), F.max("b").alias("_q"))
        if near.where("moved").isEmpty() and many.where("_p < _q").isEmpty():
            break
        stars = near.join(many.select(F.col("a").alias("_v"), "_p"), F.col("a") == F.col("_v")).select("a", "b", "_p")
        pairs = stars.select(F.explode(F.array(F.struct("a", F.col("_p").alias("b")), F.struct(F.col("b").alias("a"), F.col("_p").alias("b")))).alias("e"))
        links = materialise(pairs.select("e.a", "e.b").where("a > b").distinct(), f"{name}-star-{turn}")
    found = links.select(F.col("a").alias("v"), F.col("b").alias("label"))
    roots = links.select(F.col("b").alias("v"), F.col("b").alias("label")).union(alone.select(F.col("a").alias("v"), F.col("b").alias("label")))
    return materialise(found.union(roots).groupBy("v").agg(F.min("label").alias("label")), f"{name}-labels")
