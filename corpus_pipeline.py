"""The corpus pipeline: documents to token records in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the session's shared folder and reads it again for the next stage.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nameloom.llm import ngram_join, quality_lines, source_mix, template_decontamination, token_records
from nameloom.llm.common import materialise, table
from nameloom.llm.queries import tokenizer_file

#: The tokenizer and end id of the last stage.
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many documents of a host share go from the others."""
    return quality_lines.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8), the one with the smallest doc_id."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers or names, go."""
    return template_decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stay, are cut or go until each source has its budget of words."""
    return source_mix.apply_mix(docs, source_mix.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the mix: doc_id, start, n_tokens, ids_crc32, shard and record, read back from the files."""
    return token_records.token_records(docs, tokenizer_file(TOKENIZER), END_ID)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix), ("token-ID output", tokens)]

#: The last stage runs a tokenizer, which SQL cannot; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
