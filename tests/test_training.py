import random

from test_retrieval import F1, entities

from nameloom.operators import training


def triplets(df):
    return [(r["anchor"], r["positive"], r["hard_negative"], r["entity_id"]) for r in df.orderBy("ent_ord", "name_ord").collect()]


def holdouts(spark, rows=()):
    return spark.createDataFrame(list(rows), "entity_id string, ent_ord long, heldout string, heldout_norm string")


def test_triplets(spark):
    out = triplets(training.training_triplets(entities(spark, F1), holdouts(spark), 4))
    assert len(out) == 12 and all(p != n for _, p, n, _ in out)
    assert {e: n for _, _, n, e in out} == {"A": "表皮葡萄球菌", "B": "金黄色葡萄球菌", "C": "金黄色葡萄球菌", "D": "金黄色葡萄球菌"}


def test_held_out_alias_is_no_anchor(spark):
    out = triplets(training.training_triplets(entities(spark, F1[:2]), holdouts(spark, [("A", 0, "金葡菌", "金葡菌")]), 4))
    assert out and "金葡菌" not in [a for a, *_ in out]


def test_eval_rows_have_both_splits(spark):
    df = training.split_entities(entities(spark, F1), 0.25, 1)
    train, held = df.where("not is_eval"), df.where("is_eval")
    rows = training.evaluation_queries(train, held, training.alias_holdouts(train, 1.0, 1), 2).collect()
    assert {r["split"] for r in rows} == {"alias", "entity"} and sum(r["split"] == "entity" for r in rows) == 2


def test_null_names_and_ranks_group(spark):
    rows = [("A", "甲", None, "species", None, None), ("B", "乙", None, "species", None, None)]
    assert {r["hard_negative"] for r in training.hard_negatives(entities(spark, rows)).collect()} == {"甲", "乙"}
    rows = [("P", "先", "Gg x", "species", None, None), ("A", "甲", "Aa x", None, None, None), ("B", "乙", "Bb x", None, None, None)]
    out = {r["entity_id"]: r["hard_negative"] for r in training.hard_negatives(entities(spark, rows)).collect()}
    assert out == {"P": "甲", "A": "乙", "B": "甲"}


def test_lone_entity_is_its_own_negative(spark):
    assert training.hard_negatives(entities(spark, F1[:1])).first()["hard_negative"] == "金黄色葡萄球菌"


def test_parity_split(spark):
    order = list(range(4))
    random.Random(1).shuffle(order)
    out = training.parity_split(entities(spark, F1), 0.25, 1).orderBy("split_ord").collect()
    assert [r["ent_ord"] for r in out] == order and [r["is_eval"] for r in out] == [True, False, False, False]
