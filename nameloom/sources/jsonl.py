"""JSON Lines sources and sinks with file positions as ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameloom.schema import ENTITY

REQUIRED = ("entity_id", "scientific_name")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1 within the file, value) of the lines that are not blank."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return rows.where(F.trim(F.regexp_replace("value", r"[\s\x1c-\x1f]+", " ")) != "")


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = T.StructType([*[f for f in schema if f.name != "ent_ord"], T.StructField("_bad", T.StringType())])
    return _lines(spark, path).withColumn("row", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))


def _refuse(spark: SparkSession, found: list, what: str) -> None:
    """Raise for the first row found, naming file and line; lines are counted only then."""
    if not found:
        return
    file, at, value = found[0]["file"], found[0]["at"], found[0]["value"]
    same = spark.read.text(file).select("value", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("p"))
    before = same.where(F.col("at") < at).count()  # lines of earlier parts have smaller numbers
    raise ValueError(f"{what} at {file}, line {before + 1}: {value[:120]}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON Lines file with ``ent_ord`` (order in the file); fails on the first bad line, naming file and line.

    The check is a pass of its own before anything is read, so it does not depend on the columns a query uses.
    """
    rows = _parsed(spark, path, schema)
    _refuse(spark, rows.where("row._bad is not null").select("file", "at", "value").take(1), "invalid JSON")
    return rows.select(*[F.col(f"row.{f.name}").alias(f.name) for f in schema if f.name != "ent_ord"], F.col("at").cast("long").alias("ent_ord"))


def read_bare(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON Lines file with the fields that it has; fails on a bad line."""
    return spark.read.option("mode", "FAILFAST").json(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue; the required keys must be present in each line (null values pass)."""
    rows = read_jsonl(spark, path, ENTITY)
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    missing = _lines(spark, path).where(~F.forall(F.array(*map(F.lit, REQUIRED)), lambda k: F.array_contains(keys, k)))
    _refuse(spark, missing.select("file", "at", "value").take(1), f"an entity lacks one of {REQUIRED}")
    return rows


#: Fields of training rows.
TRIPLET = T.StructType([T.StructField(n, T.StringType()) for n in ("anchor", "positive", "hard_negative", "entity_id")])


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """Training rows (anchor, positive, hard_negative or null, entity_id); fails if there are none or one lacks its pair."""
    rows = read_jsonl(spark, path, TRIPLET).withColumn("hard_negative", F.nullif("hard_negative", F.lit("")))
    if rows.isEmpty():
        raise ValueError(f"no training rows in {path}")
    if not rows.where("anchor is null or positive is null").isEmpty():
        raise ValueError(f"a training row in {path} lacks anchor or positive")
    return rows.drop("ent_ord")


def write_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON object per line, nulls kept; one ordered file if ``order`` is given (exports), else one per partition."""
    rows = df.orderBy(order).drop(order).coalesce(1) if order else df
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
