"""Names that very many entities share: every link, in order, without one task or row that holds them all."""

import re

import pytest
from pyspark.sql import functions as F

from nameloom.operators import cascade, names
from nameloom.plans.catalogue import QUERIES
from nameloom.schema import ENTITY

N = 5000


@pytest.fixture
def shuffled(spark):
    """Joins shuffle, as they do on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def same_name(spark, n):
    return spark.createDataFrame([(f"E{i:05d}", f"No {i}", "Foo bar", None, None, None, None, i) for i in range(n)], ENTITY)


def asked(spark, text):
    return spark.createDataFrame([(q, text, text) for q in range(40)], "qid long, query string, norm string")


@pytest.mark.parametrize("kind", ["alias", "abbreviation"])
def test_hits_of_one_text_are_dealt_out(shuffled, kind):
    table = {"alias": names.alias_dictionary, "abbreviation": names.abbreviation_lookup}[kind](same_name(shuffled, N))
    hits = {"alias": cascade.alias_hits, "abbreviation": cascade.abbreviation_hits}[kind](asked(shuffled, {"alias": "foo bar", "abbreviation": "f. bar"}[kind]), table)
    rows = hits.select("qid", "pos", "entity_id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["qid"], r["pos"], r["entity_id"]) for r in rows) == [(q, i, f"E{i:05d}") for q in range(40) for i in range(N)]
    assert len({r["task"] for r in rows}) > 1


def parts(spark, path, n):
    rows = spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.concat(F.lit("Brand#"), (F.col("id") % 5).cast("string")).alias("p_brand"), F.lit("SMALL").alias("p_type"))
    rows.write.parquet(f"{path}/part.parquet")
    return str(path)


def test_stage_counts_meet_as_counts(spark, tmp_path):
    found = QUERIES["cascade_stage_counts"](spark, parts(spark, tmp_path, N))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner.*\n.*Aggregate \[_text", plan)
    assert {r["source"]: r["n_rows"] for r in found.collect()} == {"ambiguous_alias": N * N, "ambiguous_abbreviation": N * N, "embedding": 5 * N}


def test_equal_names_rank_by_order(spark):
    words = "antique blue red small hot large new green".split()
    rows = [(f"E{i:05d}", f"No {i}", f"{words[i % 8]} {noun}", None, None, None, None, i) for i, noun in enumerate(["ring", "bolt", "widget"] * 800)]
    df = spark.createDataFrame(rows, ENTITY)
    queries = df.select("scientific_name").distinct().select(F.concat("scientific_name", F.lit("x")).alias("qid"), F.concat("scientific_name", F.lit("x")).alias("query"))
    for backend in ("char-ngram-sparse", "char-ngram-md5"):
        found: dict = {}
        for r in sorted(cascade.retrieve(queries, cascade.build_index(df, backend)).collect(), key=lambda r: r["pos"]):
            found.setdefault(r["qid"], []).append(r["entity_id"])
        assert found == {f"{name}x": [r[0] for r in rows if r[2] == name][:5] for name in {r[2] for r in rows}}


def test_cascade_results_are_dealt_out(shuffled, tmp_path):
    found = QUERIES["cascade_results"](shuffled, parts(shuffled, tmp_path, 100)).select("qid", F.spark_partition_id().alias("task"))
    assert "_slice" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 2 * 100 * 100 + 5 * 100
