"""Queries on whole tables: every part, also those that share their name, and every document, also in other scripts."""

import os
import re
from collections import Counter

import pytest
from test_oracles import SF

from nameloom.plans.catalogue import ORACLES, QUERIES, catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_queries_read_every_part(spark):
    parts = {r["entity_id"] for r in catalog(spark, SF).select("entity_id").collect()}
    assert len(parts) > catalog(spark, SF).select("scientific_name").distinct().count()
    for name, key in (("entity_split", "entity_id"), ("ngram_sparse_cosine_topk", "qid"), ("alias_ambiguous", "qid")):
        assert {r[key] for r in QUERIES[name](spark, SF).select(key).collect()} == parts
    assert not any("PARTITION BY scientific_name" in sql for sql in ORACLES.values())


def test_cascade_asks_for_every_part(spark):
    rows, found = catalog(spark, SF).select("entity_id", "scientific_name").collect(), QUERIES["cascade_results"](spark, SF).cache()
    assert {r["qid"] for r in found.select("qid").collect()} == {f"{r['entity_id']}:{k}" for r in rows for k in range(3)}
    same = Counter(r["scientific_name"] for r in rows)
    hits = Counter(r["qid"] for r in found.where("source in ('exact', 'ambiguous_alias')").collect())
    assert hits == {f"{r['entity_id']}:0": same[r["scientific_name"]] for r in rows}


def test_latin_names_of_all_documents(spark, tmp_path):
    texts = ["Étude: Homo sapiens sapiens, déjà vu", "Homo sapiens in ASCII", "学名 Bacillus subtilis subsp. spizizenii 株", "Él Niño", "naïve", "", None, "Ça va. Escherichia\u00a0coli strain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pattern = re.compile(r"\b([A-Z][a-z]+(?:\s+[a-z][a-z.-]+)+(?:\s+subsp\.\s+[a-z-]+)?)\b")
    for d in (str(tmp_path), SF):
        want = {r["doc_id"]: m[1] if (m := pattern.search(r["text"] or "")) else "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
        found = QUERIES["latin_name_extract_unicode"](spark, d).collect()
        assert len(found) == len(want) and {r["doc_id"]: r["latin"] for r in found} == want
        ascii_only = {r["doc_id"]: r["latin"] for r in QUERIES["latin_name_extract"](spark, d).collect()}
        assert ascii_only.items() <= want.items() and len(ascii_only) < len(want)
