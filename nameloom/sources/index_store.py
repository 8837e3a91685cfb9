"""Index artefacts as a folder of Parquet tables, all written from one snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.operators.cascade import Index

TABLES = ("attributes", "aliases", "abbreviations", "records")


def save(index: Index, folder: str) -> None:
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = index.attributes.sparkSession
    spark.createDataFrame([(index.backend,)], "backend string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def load(spark: SparkSession, folder: str, backend: str | None = None) -> Index:
    """The stored index; refuses one that was built for another backend than asked for."""
    found = spark.read.parquet(f"{folder}/meta").first()["backend"]
    if backend and backend != found:
        raise ValueError(f"the index was built for {found}, not {backend}")
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES), found)


def save_alias_json(aliases: DataFrame, path: str) -> None:
    """The alias dictionary as one JSON object, keys sorted: {norm: {entity_ids, matched_names}}.

    Entries are formatted by the executors and sorted there; the driver writes them one after the other.
    """
    entry = F.concat(F.to_json(F.array("norm")), F.lit("\t"), F.to_json(F.struct("entity_ids", "matched_names")))
    rows = aliases.orderBy("norm").select(entry.alias("e")).toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for number, row in enumerate(rows):
            key, _, value = row["e"].partition("\t")
            f.write(f"{',' if number else ''}\n  {key[1:-1]}: {value}")
        f.write("\n}\n")


def load_alias_json(spark: SparkSession, path: str) -> DataFrame:
    """(norm, entity_ids, matched_names) of a dictionary written by ``save_alias_json``."""
    kind = "map<string, struct<entity_ids: array<string>, matched_names: array<string>>>"
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("norm", "e"))
    return whole.select("norm", "e.entity_ids", "e.matched_names")
