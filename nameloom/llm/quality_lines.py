"""Quality rules: lines that too many documents of a host share, and what they leave.

Pass 1 hashes the normalised lines of every text (case, white space and digits
folded), counts the distinct texts of each host (``source``) that hold a line,
and keeps the lines held by more than ``limit`` = max(``min_docs``,
``max_share`` of the host's distinct texts).  Copies of a text count once, so
that a much-copied document is not mistaken for boilerplate.  A host can have
at most (mean lines per text / ``max_share``) such lines, or, where
``min_docs`` decides, (its lines / ``min_docs``) of fewer than ``min_docs /
max_share`` texts, so one array per host is small whatever the corpus.

Pass 2 joins that array to the documents by host (broadcast below a checked
size, else shuffled) and decides each document in one projection: base rules,
lines removed, and a document whose rest is under ``min_words`` words or under
``min_rest`` of its words is depleted and rejected.

Cases: null text has no words and fails the base rules; null source is a host
of its own; repeated rows are judged alike; an empty table gives an empty
result; very long texts are judged like any
other; other columns pass through and may have any name, those that ``judge`` adds are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import WORD, materialise, n_words, packed, unpacked, words

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, SYMBOLS = 10, 5, 20, r"[^#*$%&|<>]+"
#: Up to so many hosts with common lines, and so many such lines, are sent to every executor.
BROADCAST_HOSTS, BROADCAST_LINES = 20_000, 400_000


def line_hash(line: Column) -> Column:
    """Hash of a line without regard to case, digits' values and the amount of white space."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.trim(F.lower(line)), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _worded(text: Column) -> Column:
    return F.filter(lines(text), lambda line: line.rlike(WORD))


def common_lines(docs: DataFrame, max_share: float = 0.05, min_docs: int = 10) -> DataFrame:
    """(host, bad array<long>): hashes of the lines above the limit, one row per host that has any."""
    hashed = docs.select(F.col("source").alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.array_distinct(F.transform(_worded(F.col("text")), line_hash)).alias("_lines"))
    lined = hashed.select("host", "t", F.explode("_lines").alias("line")).distinct()
    per_line = lined.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    per_host = docs.select(F.col("source").alias("_host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("of"))
    above = per_line.join(per_host, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > max_share * F.col("of"))
    return above.groupBy("host").agg(F.collect_set("line").alias("bad"))


def base_features(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    df = df.withColumn("n_words", F.size("_h").cast("long"))
    h = F.col("_h")
    df = df.withColumn("_w", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(again, F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True)), lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    worded = _worded(F.col("text"))
    df = df.withColumn("_lines", worded)
    df = df.withColumns({
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_h", "_w", "_s", "_p", "_lines")


#: Columns that ``judge`` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_rest_words", "kept")


def judge(docs: DataFrame, max_share: float = 0.05, min_docs: int = 10, min_words: int = MIN_WORDS, min_rest: float = 0.5) -> DataFrame:
    """``docs`` with the base features, clean_text, n_rest_words and kept; columns of those names are replaced."""
    df = _judged(docs, max_share, min_docs, min_words, min_rest)
    return df.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def _judged(docs: DataFrame, max_share: float, min_docs: int, min_words: int, min_rest: float) -> DataFrame:
    """The rows of ``docs`` as ``_doc``, text, source and the columns ``ADDED``."""
    bad = materialise(common_lines(docs, max_share, min_docs), "common-lines")
    size = bad.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("bad")), F.lit(0))).first()
    bad = bad.select(F.col("host").alias("_host"), F.col("bad").alias("_bad"))
    if size[0] <= BROADCAST_HOSTS and size[1] <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    df = packed(docs, "text", "source").join(bad, F.col("source").eqNullSafe(F.col("_host")), "left")
    df = base_features(df)
    rest = F.array_join(F.filter(lines(F.col("text")), lambda line: ~F.array_contains(F.col("_bad"), line_hash(line)) | ~line.rlike(WORD)), "\n")
    df = df.withColumn("clean_text", F.when(F.col("_bad").isNull(), F.col("text")).otherwise(rest))
    df = df.withColumn("n_rest_words", F.when(F.col("_bad").isNull(), F.col("n_words")).otherwise(n_words(F.col("clean_text"))))
    depleted = (F.col("n_rest_words") < min_words) | (F.col("n_rest_words") < min_rest * F.col("n_words"))
    return df.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_host", "_bad")


def keep_good(docs: DataFrame, max_share: float = 0.05, min_docs: int = 10, min_words: int = MIN_WORDS, min_rest: float = 0.5) -> DataFrame:
    """The documents kept, with the columns of ``docs``; common lines are gone from their texts."""
    # A filter on a projection that is not deterministic stays above it; pushed down, it would
    # hold copies of every expression that ``kept`` is made of.
    df = _judged(docs, max_share, min_docs, min_words, min_rest).withColumn("_n", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_n") >= 0))
    return unpacked(df, docs.columns, text=F.col("clean_text"), n_chars=F.length("clean_text").cast("long"))
