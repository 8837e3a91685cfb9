import math

import pytest
from pyspark.sql import functions as F

from nameloom.functions.features import blake2b_vector
from nameloom.functions.text import normal_form
from nameloom.operators import cascade, evaluation, names, vector
from nameloom.schema import ENTITY
from nameloom.sources import index_store, jsonl

F1 = [
    ("A", "金黄色葡萄球菌", "Staphylococcus aureus", "species", ["金葡菌", "S. aureus"], []),
    ("B", "表皮葡萄球菌", "Staphylococcus epidermidis", "species", ["表葡菌", "S. epidermidis"], []),
    ("C", "大肠埃希氏菌", "Escherichia coli", "species", ["大肠杆菌", "E. coli"], []),
    ("D", "肺炎链球菌", "Streptococcus pneumoniae", "species", ["肺炎球菌", "S. pneumoniae"], None),
]
F2 = [("A", "测试甲菌", "Staphylococcus testii", "species", [], []), ("B", "测试乙菌", "Streptococcus testii", "species", [], [])]


def entities(spark, rows):
    return spark.createDataFrame([(*r, None, i) for i, r in enumerate(rows)], ENTITY)


def ask(spark, rows, queries, **kw):
    backend = kw.pop("backend", "char-ngram-blake2b")
    index = cascade.build_index(entities(spark, rows), backend)
    df = spark.createDataFrame(list(enumerate(queries)), "qid long, query string")
    return sorted(cascade.retrieve(df, index, **kw).collect(), key=lambda r: (r["qid"], r["pos"]))


def test_exact_aliases(spark):
    out = ask(spark, F1, ["金葡菌", "Ｅ． ｃｏｌｉ", " s.AUREUS；"])
    assert [(r["entity_id"], r["source"], r["score"]) for r in out] == [("A", "exact", 1.0), ("C", "exact", 1.0), ("A", "exact", 1.0)]


def test_abbreviation_ambiguous_or_expanded(spark):
    rows = [*F2, ("C", "大肠埃希氏菌", "Escherichia coli", "species", None, None)]
    out = ask(spark, rows, ["S. testii", "E.coli"], top_k=1)
    assert [(r["qid"], r["entity_id"], r["source"], r["ambiguous"]) for r in out] == [(0, "A", "ambiguous_abbreviation", True), (0, "B", "ambiguous_abbreviation", True), (1, "C", "expanded_exact", False)]
    assert out[2]["message"] == "Latin abbreviation expanded from E. coli."


def test_empty_query_ranks_all_by_order(spark):
    for backend in cascade.BACKENDS:
        out = ask(spark, F1, ["，"], backend=backend)
        assert [(r["entity_id"], r["score"], r["low_confidence"]) for r in out] == [(x, 0.0, True) for x in "ABCD"]


def test_ambiguous_alias_ignores_top_k(spark):
    rows = [("A", "甲", None, None, ["X"], None), ("B", "乙", None, None, ["x"], None)]
    out = ask(spark, rows, ["x"], top_k=1)
    assert [(r["entity_id"], r["source"], r["matched_name"]) for r in out] == [("A", "ambiguous_alias", "X"), ("B", "ambiguous_alias", "X")]


def test_vector_search_equals_brute_force(spark):
    for query in ("黄色葡萄球菌", "Escherichia colli"):
        q, best = blake2b_vector(normal_form(query)), {}
        for i, r in enumerate(F1):
            for name in [r[1], r[2], *r[4]]:
                s = math.fsum(a * b for a, b in zip(q, blake2b_vector(normal_form(name))))
                if r[0] not in best or s > best[r[0]][0]:
                    best[r[0]] = (s, name, i)
        want = [(k, v[1], round(v[0], 6)) for k, v in sorted(best.items(), key=lambda x: (-x[1][0], x[1][2]))][:3]
        out = ask(spark, F1, [query], top_k=3, threshold=0.1)
        assert [(r["entity_id"], r["matched_name"], r["score"]) for r in out] == want and out[0]["source"] == "embedding"


def test_nan_threshold_flags_nothing(spark):
    assert not any(r["low_confidence"] for r in ask(spark, F1, ["zzz"], threshold=float("nan")))


def test_repeated_entity_ids(spark):
    rows = [("A", "甲", "Old name", None, None, None), ("B", "乙", "Other name", None, None, None), ("A", "丙", "New name", None, None, None)]
    out = ask(spark, rows, ["old  NAME"])
    assert [(r["entity_id"], r["scientific_name"], r["matched_name"]) for r in out] == [("A", "New name", "Old name")]


def test_candidate_modes(spark):
    df = entities(spark, F1[:1])
    canonical, every = ([r["name"] for r in names.explode_names(df, m).orderBy("name_ord").collect()] for m in ("canonical", "all-names"))
    assert canonical == ["金黄色葡萄球菌", "Staphylococcus aureus"] and every[2:] == ["金葡菌", "S. aureus"]


def test_metrics(spark):
    rows = [("a", "x", 1), ("b", "x", None), ("c", "y", 3), ("d", "y", 4)]
    out = {r["bucket"]: tuple(r)[1:] for r in evaluation.metrics(spark.createDataFrame(rows, "qid string, split string, rank int")).collect()}
    assert out == {"all": (4, 0.25, 0.5, 0.3958), "x": (2, 0.5, 0.5, 0.5), "y": (2, 0.0, 0.5, 0.2917)}


def test_dot_of_unequal_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0, 5.0])], "a array<double>, b array<double>")
    assert df.select(vector.dot(F.col("a"), F.col("b"))).first()[0] == 11.0


def test_recall_report(spark):
    df = entities(spark, F1)
    s = cascade.recall_summary(cascade.recall_report(df, cascade.build_index(df))).first()
    assert tuple(s) == (8, 8, 1.0, 8, 0)


def test_store_and_sources(spark, tmp_path):
    path = tmp_path / "entities.jsonl"
    path.write_text('{"entity_id": "A", "scientific_name": "Foo bar", "aliases": ["x"], "metadata": {"k": 1}}\n\n {"entity_id": "B", "scientific_name": null}\n', encoding="utf-8")
    df = jsonl.read_entities(spark, str(path))
    assert [(r["entity_id"], r["aliases"]) for r in df.orderBy("ent_ord").collect()] == [("A", ["x"]), ("B", None)]
    index_store.save(cascade.build_index(df), str(tmp_path / "index"))
    loaded = index_store.load(spark, str(tmp_path / "index"))
    assert cascade.index_status(loaded).first()["name_vectors"] == 2
    with pytest.raises(ValueError):
        index_store.load(spark, str(tmp_path / "index"), "char-ngram-md5")
    path.write_text('{"entity_id": "A"}\n', encoding="utf-8")
    with pytest.raises(ValueError):
        jsonl.read_entities(spark, str(path))
    path.write_text('{"entity_id": "A", "scientific_name": "x"}\n{bad\n', encoding="utf-8")
    with pytest.raises(Exception, match="invalid JSON|lacks"):
        jsonl.read_jsonl(spark, str(path), ENTITY).collect()
