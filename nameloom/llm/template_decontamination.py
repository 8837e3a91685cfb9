"""Benchmark decontamination by canonical templates.

Every token becomes a template token: numbers ``<num>``, numbers with their unit ``<qty>``,
units after a number ``<unit>``, capitalised words inside a sentence ``<name>``,
all else its lower case without surrounding punctuation.  Windows of ``window`` template
tokens (with at least ``literals`` words that are no placeholder) of the benchmark are hash-joined to
those of all documents.  An item is found in a document if at least ``coverage`` of its
windows are, and if its slots fit: over the matching windows, each value of the
item must stand for one value in the document and the reverse, for at least
``consistency`` of the values.  So a question with other numbers and names is caught,
and a text that merely has its shape is not.

An item may stand in a document several times with other values.  So where all hits of a document
together do not fit, each occurrence is judged by itself: hits are grouped by their
diagonal (position in the document less that in the item), exactly and in overlapping bands of doubling width
(insertions shift the diagonal) up to all of the document's diagonals, and one group that is covered and fits is enough.

The benchmark's windows are broadcast up to ``BROADCAST_WINDOWS`` of them, beyond that both
sides are shuffled by hash.  Only matching windows carry words.

Cases: null texts have no windows; items shorter than a window are never found; rows with equal or
null doc_ids are judged each by its own text; items with equal texts
are each reported; an empty table on either side gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import by_ids, materialise, packed, unpacked, words

WINDOW, LITERALS, COVERAGE, CONSISTENCY = 5, 3, 0.5, 0.8
BROADCAST_WINDOWS = 200_000
PUNCTUATION = ".,;:!?\"'()[]{}«»“”„’‘…"
#: Units that make a slot after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l gal s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent % kb mb gb tb hz khz mhz ghz w kw mw v a j kj cal kcal".split()
SLOTS = ("<num>", "<qty>", "<unit>", "<name>")


def canonical(token: Column, before: Column) -> Column:
    """Template token of ``token``, which follows ``before`` (null at the start)."""
    bare = F.btrim(token, F.lit(PUNCTUATION))
    first = F.ascii(bare)
    digit = (first >= 48) & (first <= 57)
    signed = F.ascii(token).isin(43, 45, 36) & token.rlike(r"^[+$-][0-9]")
    upper = (first >= 65) & (first <= 90)
    inside = before.isNotNull() & ~F.right(before, F.lit(1)).isin(".", "!", "?", ":")
    after_number = (F.ascii(before) >= 48) & (F.ascii(before) <= 57)
    return (
        F.when(digit, F.when(bare.rlike(r"^[0-9][0-9.,]*[\p{L}%°]+$"), F.lit("<qty>")).otherwise(F.lit("<num>")))
        .when(signed, F.lit("<num>"))
        .when(F.coalesce(after_number, F.lit(False)) & F.lower(bare).isin(*UNITS), F.lit("<unit>"))
        .when(upper & inside, F.lit("<name>"))
        .otherwise(F.lower(bare))
    )


def _windows(df: DataFrame, window: int) -> DataFrame:
    """Add _words (tokens) and _hashes (of the template windows, in order)."""
    df = df.withColumn("_words", words(F.col("text")))
    tokens = F.col("_words")
    df = df.withColumn("_t", F.transform(tokens, lambda w, i: F.xxhash64(canonical(w, F.get(tokens, i - 1)))))
    t = F.col("_t")
    hashes = F.transform(F.sequence(F.lit(0), F.size(t) - window), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(window)]))
    return df.withColumn("_hashes", F.when(F.size(t) >= window, hashes)).drop("_t")


def _slice(at: Column, window: int) -> Column:
    """``window`` tokens from position ``at`` (from 0), after the token before them (null at the start)."""
    return F.concat(F.array(F.get(F.col("_words"), at - 1)), F.slice(F.col("_words"), at + 1, F.lit(window)))


def benchmark_windows(items: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(item_id, item, n_windows, ipos, h, iwords) of the windows with enough literal words.

    Words, template tokens and windows are written one after the other: each is computed once, and
    long items are dealt to several tasks.
    """
    df = items.select("item_id", "text").withColumn("item", F.xxhash64("item_id", "text")).repartition("item")
    df = materialise(df.select("item_id", "item", words(F.col("text")).alias("_words")), "benchmark-words")
    tokens = F.transform("_words", lambda w, i: canonical(w, F.get(F.col("_words"), i - 1)))
    df = materialise(df.withColumn("_tokens", tokens), "benchmark-tokens")
    t = F.col("_tokens")
    df = df.withColumn("_t", F.transform(t, lambda x: F.xxhash64(x)))
    starts = F.when(F.size(t) >= window, F.sequence(F.lit(0), F.size(t) - window))
    slot = F.transform(t, lambda x: x.isin(*SLOTS).cast("int"))
    plain = lambda i: F.size(F.filter(F.slice(slot, i + 1, F.lit(window)), lambda x: x == 0))
    one = lambda i: F.struct(i.alias("ipos"), F.xxhash64(*[F.get(F.col("_t"), i + j) for j in range(window)]).alias("h"), plain(i).alias("plain"), _slice(i, window).alias("iwords"))
    df = df.select("item_id", "item", F.explode(F.transform(starts, one)).alias("w")).select("item_id", "item", "w.*")
    df = materialise(df, "benchmark-slices").where(F.col("plain") >= literals).drop("plain")
    counts = df.groupBy("item").agg(F.countDistinct("ipos").alias("n_windows")).withColumnRenamed("item", "_item")
    return df.join(counts, F.col("item") == F.col("_item")).drop("_item")


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """One row per document and item found: doc_id, item_id, n_windows, n_matched, n_values, n_conflicts, row."""
    bench = materialise(benchmark_windows(items, window, literals), "benchmark")
    size = bench.count()
    df = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    df = _windows(df, window).select("doc_id", "row", "_words", F.posexplode_outer("_hashes").alias("pos", "h"))
    side = F.broadcast(bench) if size <= BROADCAST_WINDOWS else bench
    if size > BROADCAST_WINDOWS:  # then words travel; those of the window suffice
        df = df.withColumn("dwords", _slice(F.col("pos"), window)).drop("_words")
        hits = df.join(side, "h").select("doc_id", "row", "item_id", "item", "n_windows", "ipos", "pos", "iwords", "dwords")
    else:
        hits = df.join(side, "h").select("doc_id", "row", "item_id", "item", "n_windows", "ipos", "pos", "iwords", _slice(F.col("pos"), window).alias("dwords"))
    hits = materialise(hits, "template-hits")
    pair = ["row", "item"]
    diagonal = F.col("pos") - F.col("ipos")
    found = hits.groupBy(*pair).agg(F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n_windows").alias("n_windows"), F.countDistinct("ipos").alias("n_matched"), F.min(diagonal).alias("_lo"), F.max(diagonal).alias("_hi"))
    found = materialise(found.where(F.col("n_matched") >= coverage * F.col("n_windows")), "template-found")
    fit = F.col("n_values") - F.col("n_conflicts") >= consistency * F.col("n_values") - 1e-9  # equality counts, whatever the rounding
    names = ["doc_id", "item_id", "n_windows", "n_matched", "n_values", "n_conflicts", "row"]
    whole = materialise(found.join(_fit(_slots(hits.join(found.select(*pair), pair, "left_semi"), pair, window), pair), pair, "left").na.fill(0, ["n_values", "n_conflicts"]), "template-whole")

    left = whole.where(~fit & (F.col("_lo") < F.col("_hi")))
    parts = hits.join(left.select(*pair, "_lo", "_hi"), pair).withColumn("group", F.explode(_bands(diagonal, F.col("_lo"), F.col("_hi"))))
    parts = parts.select(*pair, "group", "n_windows", "ipos", "iwords", "dwords")
    group = [*pair, "group"]
    covered = parts.groupBy(*group).agg(F.first("n_windows").alias("n_windows"), F.countDistinct("ipos").alias("n_matched"))
    covered = covered.where(F.col("n_matched") >= coverage * F.col("n_windows")).select(*group, "n_matched")
    judged = covered.join(_fit(_slots(parts, group, window), group), group, "left").na.fill(0, ["n_values", "n_conflicts"])
    best = judged.where(fit).groupBy(*pair).agg(F.min_by(F.struct("n_matched", "n_values", "n_conflicts"), F.struct(-F.col("n_matched"), "n_conflicts", "group")).alias("_b"))
    single = left.select(*pair, "doc_id", "item_id", "n_windows").join(best, pair).select(*pair, "doc_id", "item_id", "n_windows", "_b.*")
    return whole.where(fit).select(*names).unionByName(single.select(*names))


def _bands(diagonal: Column, lo: Column, hi: Column) -> Column:
    """Groups (width, shift, number) of a diagonal between ``lo`` and ``hi``: any range of half a width lies in one group of that width."""
    top = F.ceil(F.log2((hi - lo + 1).cast("double"))).cast("int")
    group = lambda k, shift: F.struct(k.alias("k"), F.lit(shift).alias("shift"), F.floor((diagonal - lo + shift * F.pow(F.lit(2.0), k - 1)) / F.pow(F.lit(2.0), k)).cast("long").alias("number"))
    wide = F.transform(F.sequence(F.lit(1), top), lambda k: F.array(group(k, 0), group(k, 1)))
    return F.concat(F.array(group(F.lit(0), 0)), F.flatten(wide))


def _slots(hits: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Distinct (keys, kind, a, b): the item's value ``a`` and the document's ``b`` of each slot of the matching windows."""
    w, v = F.col("iwords"), F.col("dwords")
    plain = lambda x: F.lower(F.btrim(x, F.lit(PUNCTUATION)))
    slots = F.filter(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.struct(canonical(F.get(w, i), F.get(w, i - 1)).alias("kind"), plain(F.get(w, i)).alias("a"), plain(F.get(v, i)).alias("b"))), lambda s: s["kind"].isin(*SLOTS))
    return hits.select(*keys, F.explode(slots).alias("s")).select(*keys, "s.kind", "s.a", "s.b").distinct()


def _fit(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_values, n_conflicts): values of either side, and those that stand for more than one of the other."""
    one = values.groupBy(*keys, "kind", "a").agg(F.count(F.lit(1)).alias("n"))
    two = values.groupBy(*keys, "kind", "b").agg(F.count(F.lit(1)).alias("n"))
    return one.select(*keys, "n").unionByName(two.select(*keys, "n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("n") > 1).alias("n_conflicts"))


def without_contaminated(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    found = materialise(contaminated(docs, items, **limits).select("row").distinct(), "template-rows")
    keyed = packed(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return unpacked(by_ids(keyed, found, "row", "left_anti"), docs.columns)
