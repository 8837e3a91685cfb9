import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nameloom.functions import text as t


#: Inputs and their canonical forms.
FORMS = [
    ("E.coli", "e. coli"), (" s.AUREUS;", "s. aureus"), ("a\x1cb", "a b"), ("x..y", "x..y"), (":;E . Coli-x, ", "e. coli-x"), ("3.Coli", "3.coli"), ("aE.coli", "ae.coli"),
    ("\tA\x0bB\n", "a b"), ("E. coli.F", "e. coli.f"), ("", ""), (",;: ", ""), ("S.\n\naureus  strain", "s. aureus strain"), ("a . b . c", "a. b . c"), ("E.-coli", "e.-coli"),
]


@pytest.mark.parametrize("raw", ["E. coli", "E.coli", "E . coli", "Ｅ． ｃｏｌｉ"])
def test_abbreviation_spellings(raw):
    assert t.normal_form(raw) == "e. coli"


@pytest.mark.parametrize("raw,form", FORMS)
def test_normal_forms(raw, form):
    assert t.normal_form(raw) == form


@given(st.text(alphabet="aE. ;,\t\x1cß　Ｅ．Σ菌-", max_size=12))
def test_normal_forms_are_trimmed_folded_and_single_spaced(s):
    form = t.normal_form(s)
    assert form == form.casefold() and form == form.strip(" ,;:，；：、") and "  " not in form and not set(form) & set("\t\x1c　．Ｅ")


def test_unicode_cases(spark):
    rows = [("Straße", "strasse"), ("ΣΑΣ", "σασ"), ("ﬁ", "fi"), ("a b", "a b"), ("是E.coli", "是e.coli"), ("E.coli菌", "e.coli菌"), (None, ""), ("", ""), ("，", "")]
    out = t.with_normalized(spark.createDataFrame(rows, "x string, want string"), "x").collect()
    assert len(out) == len(rows) and all(r["norm"] == r["want"] for r in out)


def test_native_form_equals_the_python_form_on_ascii(spark):
    df = spark.createDataFrame([(r,) for r, _ in FORMS], "x string").select("x", t.normalize_ascii(F.col("x")).alias("n"))
    assert {r["x"]: r["n"] for r in df.collect()} == dict(FORMS)


def test_long_names_are_whole(spark):
    long = "Genus " + " ".join(f"t{i}" for i in range(10_001))
    row = spark.createDataFrame([(long, "e. " + "x" * 1_100_000, "TAXON:" + "0" * 40 + "12")], "s string, n string, i string")
    out = row.select(F.get(t.abbreviated_aliases(F.col("s")), F.lit(0)).alias("a"), t.abbreviation_parts(F.col("n"))[1].alias("e"), t.numeric_suffix(F.col("i")).alias("k")).first()
    assert out["a"] == "G. " + long[6:] and len(out["e"]) == 1_100_000 and out["k"] == 12


def test_small_expressions(spark):
    df = spark.createDataFrame([("e. coli", "  Staphylococcus aureus x", "TAXON:00012", "0"), ("e coli", None, "X9", "abc")], "n string, s string, i string, p string")
    a, b = t.abbreviation_parts(F.col("n"))
    out = df.select(a.alias("a"), b.alias("b"), t.genus(F.col("s")).alias("g"), t.numeric_suffix(F.col("i")).alias("k"), t.int_parameter(F.col("p"), 5).alias("q"), t.float_parameter(F.col("p"), 0.82).alias("f"), t.abbreviated_aliases(F.trim("s")).alias("al")).collect()
    assert tuple(out[0])[:6] == ("e", "coli", "staphylococcus", 12, 1, 0.0) and out[0]["al"] == ["S. aureus x"]
    assert tuple(out[1])[:6] == (None, None, "", None, 5, 0.82)
