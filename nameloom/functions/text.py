"""Name normalisation as column expressions, with an Arrow UDF where the JVM has no built-in.

ASCII text goes through regular expressions and ``lower`` only.  Other text needs NFKC and
case folding, which Spark lacks; ``with_normalized`` applies the UDF to the distinct non-ASCII
strings alone, since Python UDFs inside ``when`` run for every row.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space, the abbreviation pattern, and punctuation dropped at the edges.
SPACE = r"[\s\x1c-\x1f]"
ABBREVIATION = rf"(?U)\b([A-Za-z]){SPACE}*\.{SPACE}*([A-Za-z][A-Za-z-]*)\b"
EDGE = r"[\s\x1c-\x1f,;:，；：、]"
ABBREVIATED = r"^[a-z]\. [a-z][a-z-]*$"

_PY_ABBREVIATION = re.compile(r"\b([A-Za-z])\s*\.\s*([A-Za-z][A-Za-z-]*)\b")
_PY_EDGE = ",;:，；：、"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _strip_edges(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)^{EDGE}+", ""), rf"(?U){EDGE}+\z", "")


def normalize_ascii(text: Column) -> Column:
    """Canonical form of ASCII names: abbreviations as ``x. epithet``, single spaces, bare edges, lower case."""
    spaced = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), ABBREVIATION, "$1. $2")
    return F.lower(_strip_edges(F.regexp_replace(spaced, rf"(?U){SPACE}+", " ")))


def display_form(text: str | None) -> str:
    """Canonical form that keeps case, but for abbreviations: upper initial, lower epithet."""
    if text is None:
        return ""
    out = unicodedata.normalize("NFKC", text).replace("。", ".")
    out = _PY_ABBREVIATION.sub(lambda m: m[1].upper() + ". " + m[2].lower(), out)
    return " ".join(out.split()).strip(_PY_EDGE + " ")


def normal_form(text: str | None) -> str:
    return display_form(text).casefold()


@F.pandas_udf(T.StringType())
def normalize_unicode(texts: pd.Series) -> pd.Series:
    """Canonical form of any text."""
    return texts.map(normal_form)


@F.pandas_udf(T.StringType())
def display_normalized(texts: pd.Series) -> pd.Series:
    return texts.map(display_form)



@F.pandas_udf(T.StringType())
def case_folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def _by_script(df: DataFrame, text: str, out: str, plain: Column, other: Column) -> DataFrame:
    """Add ``out``: ``plain`` where the text is null or ASCII, else ``other``, which may be a Python UDF."""
    ascii_only = F.coalesce(is_ascii(F.col(text)), F.lit(True))
    return df.where(ascii_only).withColumn(out, plain).unionByName(df.where(~ascii_only).withColumn(out, other))


def with_folded(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, the case-folded column ``text`` (null stays null)."""
    return _by_script(df, text, out, F.lower(F.col(text)), case_folded(F.col(text)))


def with_normalized(df: DataFrame, text: str, out: str = "norm") -> DataFrame:
    """Add ``out``, the canonical form of the column ``text``."""
    return _by_script(df, text, out, normalize_ascii(F.col(text)), normalize_unicode(F.col(text)))


def is_abbreviation(norm: Column) -> Column:
    return norm.rlike(ABBREVIATED)


def abbreviation_parts(norm: Column) -> tuple[Column, Column]:
    """(initial, epithet) of a canonical abbreviation, else nulls."""
    yes = is_abbreviation(norm)
    return F.when(yes, F.substring(norm, 1, 1)), F.when(yes, F.substr(norm, F.lit(4)))


def filled(value: Column) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(value, F.lit(""))


def canonical_name() -> Column:
    return F.coalesce(filled(F.col("standard_name_cn")), filled(F.col("scientific_name")), F.col("entity_id"))


def first_token(name: Column) -> Column:
    """First token as it is; empty if there is none."""
    return F.coalesce(F.get(F.split(_strip_space(F.coalesce(name, F.lit(""))), rf"(?U){SPACE}+"), F.lit(0)), F.lit(""))


def genus(name: Column) -> Column:
    """First token in lower case (``with_folded`` of ``first_token`` folds other scripts too); empty if there is none."""
    return F.lower(first_token(name))


def _strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def abbreviated_aliases(name: Column) -> Column:
    """``G. rest`` for a name of two tokens or more, as an array."""
    parts = F.filter(F.split(name, rf"(?U){SPACE}+"), lambda p: p != "")
    short = F.concat(F.substring(F.get(parts, F.lit(0)), 1, 1), F.lit(". "), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.when(F.size(parts) >= 2, F.array(short)).otherwise(F.array().cast("array<string>"))


def rank_of(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(" subsp. ")), F.lit("subspecies")).otherwise(F.lit("species"))


def numeric_suffix(entity_id: Column, prefix: str = "TAXON:") -> Column:
    """The number of ids made of ``prefix`` and digits, else null."""
    return F.when(entity_id.rlike(f"^{prefix}[0-9]+$"), F.substr(entity_id, F.lit(len(prefix) + 1)).try_cast("bigint"))


def int_parameter(value: Column, default: int) -> Column:
    """At least 1; ``default`` for what is no whole number."""
    return F.greatest(F.lit(1), F.coalesce(F.trim(value).try_cast("int"), F.lit(default)))


def float_parameter(value: Column, default: float) -> Column:
    return F.coalesce(F.trim(value).try_cast("double"), F.lit(float(default)))
