"""Queries of this subpackage for the entry point: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.llm import balanced_shards, chat_prefix_tree, ngram_join, phrase_automata, pii_supervision, quality_lines, source_mix, template_decontamination, token_records, warc_index
from nameloom.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = tokenizer_file("byte_bpe_50k.json")
    return chat_prefix_tree.digests(chat_prefix_tree.read_back(*chat_prefix_tree.prefix_tree(turns.unionByName(probe), path), path))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return template_decontamination.contaminated(docs, items).drop("row")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40).drop("id")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.components(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_index.capture_history(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_records.token_records(docs, tokenizer_file("word_bpe_49k.json"), end_id=1).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_lines.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrase_automata.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_pii_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_supervision.find_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


QUERIES = {f.__name__: f for f in (op1_chat_prefix_tree, op2_template_decontamination, op3_source_mix, op4_balanced_shards, op5_ngram_jaccard, op6_warc_index, op7_token_records, op8_quality_lines, op9_phrase_automata, op10_pii_supervision)}
