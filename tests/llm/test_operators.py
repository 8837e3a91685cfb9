"""Each operator on small fixtures: against brute force, and the odd cases that its docstring defines."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nameloom.llm import balanced_shards, chat_prefix_tree, ngram_join, phrase_automata, pii_supervision, quality_lines, source_mix, template_decontamination, token_records, warc_index
from nameloom.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, row string, size string, hub string, _key string, n_words string, _doc string, h string"


def prose(rng, n, words=2000):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def frame(spark, rows, parts=3):
    """doc_id, text, source and further columns with names that operators also use."""
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    rows, base, passage = [], [prose(rng, 120) for _ in range(12)], prose(rng, 70)
    for i in range(60):
        text = base[i % 12].split()
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        text = " ".join(text)
        rows.append((i, text if i % 7 else f"{prose(rng, 40)} {passage} {text}\n{passage}", ("a", "b", None)[i % 3]))
    rows += [(100, base[0], "a"), (101, base[0], "a"), (102, None, "a"), (103, "", None), (104, " \t\n", "b"), (105, "one two", "b"), (106, "ONE two", "b"), (107, "one", None), (108, prose(rng, 20_000, 50_000), "a"), (109, "é É", "a"), (110, "É é", "a")]
    return rows + [(None, base[1], "a"), (None, None, None), (5, rows[5][1], rows[5][2]), (5, base[2], "b")]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- n-gram join -----------------------------------------------------------------------------------


def shingles(text, n):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    """component of each row, rows linked by their sets; the label is the smallest doc_id that is not null."""
    sets, parent = [shingles(r[1], n) for r in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root(i)].append(r[0])
    label = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(s), label[root(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join_is_brute_force(docs, corpus, n, percent):
    found = ngram_join.components(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_components(corpus, n, percent)


def test_fingerprints_grow_with_the_input_and_narrow_ones_only_cost(spark, docs, corpus, monkeypatch):
    assert [ngram_join.fingerprint_bits(x) for x in (0, 10**6, 10**9, 10**11, 10**14)] == [32, 32, 42, 49, 59]
    shared = {}
    texts = spark.createDataFrame([(hashlib.md5(str(i).encode()).hexdigest(), prose(random.Random(i), 400)) for i in range(40)], "doc string, text string")
    for bits in (12, 50):
        shared[bits] = texts.transform(lambda t: ngram_join.shared_prefixes(t, 4, 85, 10**5, bits)).agg(F.sum(F.size("tokens"))).first()[0]
    assert shared[50] == 0 and shared[12] > 1000  # what the width is chosen by: no list of unrelated documents
    monkeypatch.setattr(ngram_join, "fingerprint_bits", lambda total: 14)
    monkeypatch.setattr(ngram_join, "LIST_SLICE", 5)
    found = ngram_join.components(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_components(corpus, 4, 85)


def test_ngram_join_of_a_star_of_near_copies(spark):
    rng = random.Random(5)
    rows, base = [], prose(rng, 200).split()
    for i in range(80):  # each near the original, few near each other
        text = list(base)
        for _ in range(5 if i else 0):
            text[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((80 - i, " ".join(text), "a"))
    found = ngram_join.components(frame(spark, rows), 4, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_components(rows, 4, 85)


def test_ngram_join_of_nothing_and_stage(docs, nothing, corpus):
    assert ngram_join.components(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    gone = {x[0] for x in brute_components(corpus, 5, 80) if x[0] is not None and x[2] < x[0]}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in corpus if r[0] not in gone)


# --- substring dedup -------------------------------------------------------------------------------


def test_phrase_automata_is_brute_force(docs, corpus, nothing):
    first, want = {}, Counter()
    key = lambda r: float("inf") if r[0] is None else r[0]
    for r in corpus:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - 49):
            first[tuple(w[i : i + 50])] = min(key(r), first.get(tuple(w[i : i + 50]), float("inf")))
    for r in corpus:
        w = WORD.findall(r[1] or "")
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < key(r) for j in range(i, i + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    assert Counter(map(tuple, phrase_automata.remove_repeats(docs).collect())) == want
    assert phrase_automata.remove_repeats(nothing).count() == 0


def test_what_no_automaton_holds_is_not_found(spark, docs, corpus, monkeypatch):
    whole = Counter(map(tuple, phrase_automata.remove_repeats(docs).collect()))
    several, found = [], phrase_automata.compile_automata
    monkeypatch.setattr(phrase_automata, "compile_automata", lambda phrases, folder: several.extend(found(phrases, folder, 5)) or several)
    assert Counter(map(tuple, phrase_automata.remove_repeats(docs).collect())) == whole and len(several) > 2 * phrase_automata.LOADED
    monkeypatch.setattr(phrase_automata, "compile_automata", lambda phrases, folder: found(phrases.limit(0), folder))
    words_of = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus}
    less = phrase_automata.remove_repeats(docs).collect()
    assert sum(r["n_removed"] for r in less) < sum(n * x[2] for x, n in whole.items())
    assert all(r["n_removed"] in (0, r["n_words"]) for r in less) and words_of[100] > 0  # whole copies still go

    bad = spark.createDataFrame([(bytearray(b"A\x80" * 8),)], "phrase binary")
    monkeypatch.setattr(phrase_automata, "compile_automata", lambda phrases, folder: found(bad, folder))
    assert Counter(map(tuple, phrase_automata.remove_repeats(docs).collect())) == Counter(map(tuple, less))


def test_words_of_any_length_have_one_hash(monkeypatch):
    from nameloom.llm import wordhash

    rng = random.Random(31)
    texts = [f"{'x' * 700} {prose(rng, 90)} {'é' * 300}", "y" * 999]
    whole = wordhash.hash_words(texts)
    windows = wordhash.window_hashes(whole.of(0), 20)
    monkeypatch.setattr(wordhash, "_CHUNK", 16)
    pieces = wordhash.hash_words(texts)
    assert (pieces.hashes == whole.hashes).all() and (wordhash.window_hashes(pieces.of(0), 20) == windows).all()


def test_components_of_a_long_chain(spark):
    from nameloom.llm.common import connected_components

    n = 400
    order = [(i * 197) % n for i in range(n)]  # neighbours in the chain have far ids
    links = spark.createDataFrame([*zip(order, order[1:]), (900, 900), (901, 902), (902, 901)], "a long, b long").repartition(2)
    labels = {r["v"]: r["label"] for r in connected_components(links).collect()}
    assert labels == dict.fromkeys(range(n), 0) | {900: 900, 901: 901, 902: 901}


# --- mixing ----------------------------------------------------------------------------------------


def water(sizes, weights, total, epochs=2):
    """Targets by resharing the excess until none is above its cap."""
    capped, out = set(), {}
    while True:
        left = total - sum(epochs * sizes[s] for s in capped)
        of = sum(weights[s] for s in sizes if s not in capped)
        out = {s: epochs * sizes[s] if s in capped else left * weights[s] / of for s in sizes}
        more = {s for s in sizes if s not in capped and out[s] > epochs * sizes[s]}
        if not more:
            return out
        capped |= more


def test_mix(docs, corpus, nothing):
    rows = source_mix.mix(docs).collect()
    sizes = Counter()
    for r in corpus:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(corpus) and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, source_mix.mix(docs.repartition(5)).collect()))
    assert source_mix.mix(nothing).count() == 0


def test_apply_mix(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 90)), "abc"[i % 3]) for i in range(50)]
    docs = frame(spark, rows)
    mixed = {r["doc_id"]: r["taken"] for r in source_mix.mix(docs).collect()}
    out = source_mix.apply_mix(docs, source_mix.mix(docs))
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert rows[r["doc_id"]][1].startswith(r["text"])
    assert out.columns == docs.columns and got == Counter({k: v for k, v in mixed.items() if v})


def test_mix_and_its_rows_with_null_and_repeated_ids(spark):
    rng = random.Random(17)
    rows = [(None, prose(rng, 20 + i), "a") for i in range(9)] + [(None, "same words here", "a")] * 7 + [(4, prose(rng, 30), "b"), (4, prose(rng, 33), "b"), (4, "again and again", "b"), (4, "again and again", "b")]
    rows += [(i + 10, prose(rng, 5), None) for i in range(30)] + [(60, None, "a"), (61, "", "b"), (62, prose(rng, 30_000, 50_000), "b")]
    docs = frame(spark, rows)
    taken = Counter()
    for r in source_mix.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    got, texts = Counter(), defaultdict(set)
    for d, t, s in rows:
        texts[(d, s)].add(t)
    for r in source_mix.apply_mix(docs, source_mix.mix(docs)).collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
        assert any((t or "").startswith(r["text"]) for t in texts[(r["doc_id"], r["source"])])
    assert got == taken and sum(got.values()) == pytest.approx(1.5 * sum(len(WORD.findall(t or "")) for _, t, _ in rows), abs=2)
    assert source_mix.apply_mix(docs.limit(0), source_mix.mix(docs.limit(0))).count() == 0


# --- sharding --------------------------------------------------------------------------------------


def test_shards(spark, docs, corpus, nothing):
    rng = random.Random(2)
    rows = corpus + [(1000 + i, "copy " * 30, "a") for i in range(300)] + [(2000 + i, prose(rng, rng.randrange(1, 200)), "b") for i in range(500)] + [(3000 + i, prose(random.Random(i // 3), 60), "c") for i in range(90)]
    out = balanced_shards.shard_rows(frame(spark, rows), shards=8).collect()
    load, slots, where, size = Counter(), defaultdict(list), defaultdict(set), Counter()
    by_crc = defaultdict(set)
    for r in out:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        by_crc[r["text_crc32"]].add(r["shard"])
        size[(r["doc_id"], r["text_crc32"], r["size"])] += 1
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert size == Counter((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t, _ in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) <= set(range(8))
    big = max(len((t or "").encode()) + 16 for _, t, _ in rows)
    assert max(load.values()) <= max(1.05 * big, 1.01 * sum(load.values()) / 8)  # one text is larger than a shard
    small = [zlib.crc32(prose(random.Random(i), 60).encode()) for i in range(30)]
    assert sum(len(by_crc[c]) > 1 for c in small) <= 3
    assert balanced_shards.shard_rows(nothing, shards=4).count() == 0


# --- quality ---------------------------------------------------------------------------------------


def test_quality_lines(spark, docs, corpus, nothing):
    rng = random.Random(9)
    plain = lambda n: prose(rng, n).translate({48 + i: 97 + i for i in range(10)})  # noqa: E731  digits count as equal
    rows = corpus + [(500 + i, f"{plain(30)}\nSubscribe  now {i}!\n{plain(20)}" if i < 25 else f"subscribe now 7!\nSUBSCRIBE NOW 9! {i - i}\nfew words", "h") for i in range(30)]
    out = Counter(tuple(r) for r in quality_lines.judge(frame(spark, rows)).select("doc_id", F.col("text"), "n_words", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text").collect())
    assert sum(out.values()) == len(rows)
    for doc_id, text, n, dup, repeat, failed, kept, clean in out:
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert (n, dup, repeat, failed) == (len(w), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
        if doc_id is not None and 500 <= doc_id < 525:
            assert kept and "Subscribe" not in clean and len(clean.split("\n")) == 2
        elif doc_id is not None and doc_id >= 525:
            assert not kept
    good = quality_lines.keep_good(frame(spark, rows))
    assert good.columns == docs.columns and {r["n_words"] for r in good.collect()} == {"e"}
    odd = frame(spark, rows).withColumnsRenamed({"row": "_host", "size": "_bad", "hub": "_h", "_key": "_lines"}).withColumn("kept", F.lit("x"))
    again = quality_lines.judge(odd)
    assert Counter(map(tuple, again.select("doc_id", "text", "n_words", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text").collect())) == out
    assert {tuple(r) for r in again.select("_host", "_bad", "_h", "_lines").collect()} == {("a", "b", "c", "d")}
    assert quality_lines.judge(nothing).count() == 0 and quality_lines.keep_good(nothing).count() == 0


# --- decontamination -------------------------------------------------------------------------------


def test_templates(spark, docs, nothing):
    item = "A train leaves Paris at 9 and travels 120 km to meet Anna at noon while 3 boxes of 5 kg each wait for Anna near the old station"
    other = item.replace("Paris", "Rome").replace("120", "95").replace("Anna", "Maria").replace("9", "7")
    mixed = "A train leaves Paris at 9 and travels 120 km to meet Anna at noon while 3 boxes of 5 kg each wait for Bob near the old station"
    items = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "too short", "x")], "item_id long, text string, row string")
    rng = random.Random(4)
    rows = [(1, f"{prose(rng, 50)} {item}. {prose(rng, 50)}", "a"), (2, f"{prose(rng, 50)} {other} {prose(rng, 5)}", "a"), (3, prose(rng, 100), "a"), (4, None, "a"), (5, item[:40], "a"), (None, item, "b")]
    found = template_decontamination.contaminated(frame(spark, rows), items)
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found.collect()) == [("1", 1), ("2", 1), ("None", 1)]
    values = {r["doc_id"]: r["n_conflicts"] for r in template_decontamination.contaminated(frame(spark, [(1, other, "a"), (2, mixed, "a")]), items, consistency=0.0).collect()}
    assert values[1] == 0 and values[2] > 0
    kept = template_decontamination.without_contaminated(frame(spark, rows), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert template_decontamination.contaminated(nothing, items).count() == 0
    assert template_decontamination.contaminated(docs, items.limit(0)).count() == 0


def brute_templates(doc, item):
    """Does any run of the item's tokens, shifted by one number, cover and fit?  For documents that hold at most one occurrence."""
    units, mark = set(template_decontamination.UNITS), template_decontamination.PUNCTUATION

    def canon(words):
        out = []
        for i, w in enumerate(words):
            bare, before = w.strip(mark), words[i - 1] if i else None
            if re.match("[0-9]", bare):
                out.append("<qty>" if re.fullmatch(r"[0-9][0-9.,]*[^\W\d_%°]+|[0-9][0-9.,]*[%°]+", bare) else "<num>")
            elif re.match(r"[+$-][0-9]", w):
                out.append("<num>")
            elif before and re.match("[0-9]", before) and bare.lower() in units:
                out.append("<unit>")
            elif re.match("[A-Z]", bare) and before and before[-1] not in ".!?:":
                out.append("<name>")
            else:
                out.append(bare.lower())
        return out

    a, b = WORD.findall(item), WORD.findall(doc)
    ca, cb = canon(a), canon(b)
    slots = ("<num>", "<qty>", "<unit>", "<name>")
    at = [i for i in range(len(a) - 4) if sum(x not in slots for x in ca[i : i + 5]) >= 3]
    where = defaultdict(list)
    for j in range(len(b) - 4):
        where[tuple(cb[j : j + 5])].append(j)
    hits = [(i, j) for i in at for j in where[tuple(ca[i : i + 5])]]

    def fits(hits):
        if not at or len({i for i, _ in hits}) < 0.5 * len(at):
            return False
        pairs = {(canon(a[max(0, i - 1) : i + 5])[k + (i > 0)], a[i + k].strip(mark).lower(), b[j + k].strip(mark).lower()) for i, j in hits for k in range(5)}
        pairs = {p for p in pairs if p[0] in slots}
        one, two = Counter((k, x) for k, x, _ in pairs), Counter((k, y) for k, _, y in pairs)
        return sum(n > 1 for n in [*one.values(), *two.values()]) <= 0.2 * (len(one) + len(two))

    return fits(hits) or any(fits([h for h in hits if h[1] - h[0] == d]) for d in {j - i for i, j in hits})


def test_templates_are_brute_force(spark):
    rng = random.Random(51)
    people, places, units = ("Anna", "Bob", "Maria", "Karl"), ("Rome", "Oslo", "Lyon"), ("km", "kg", "miles")
    verbs = "takes buys sells moves counts finds sees makes keeps".split()

    def sentence(k):
        r = random.Random(k)
        return " ".join(f"{r.choice(people)} {r.choice(verbs)} {r.randrange(2, 90)} {r.choice(units)} of {r.choice('abcdefgh')}{k}ing near {r.choice(places)} and then" for _ in range(3))

    def change(text, share):
        return " ".join(str(rng.randrange(2, 90)) if w.isdigit() and rng.random() < share else rng.choice(people) if w in people and rng.random() < share else w for w in text.split())

    items = [(i, sentence(i)) for i in range(12)] + [(50, sentence(3)), (51, None), (52, "too short"), (53, ""), (3, sentence(3))]  # equal texts, a repeated row
    rows = []
    for i in range(80):
        text = change(sentence(rng.randrange(14)), rng.choice((0, 0.2, 0.5, 1)))
        words_ = text.split()
        text = " ".join(words_[: rng.randrange(8, len(words_) + 1)])
        rows.append((i, f"{prose(rng, rng.choice((0, 3, 30)))} {text} {prose(rng, 5)}", "a"))
    rows += [(200, f"{prose(rng, 30_000, 60_000)} {sentence(2)} {prose(rng, 20_000, 60_000)}", "a"), rows[0], (None, sentence(1), "a"), (201, None, "a"), (202, "", "a")]
    found = template_decontamination.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(d, i) for d, t, _ in rows for i, x in items if x and t and brute_templates(t, x)} and 10 < len(got) < 200


def test_templates_judge_each_occurrence(spark):
    item = "A train leaves Paris at 9 and travels 120 km to meet Anna at noon while 3 boxes of 5 kg each wait for Anna near the old station"
    item += " and then a man called Peter walks 14 miles to the market of Lyon with 6 apples"
    swap = {"Paris": "Rome", "120": "95", "Anna": "Maria", "9": "7", "3": "8", "5": "2", "Peter": "Karl", "14": "31", "Lyon": "Bonn", "6": "4"}
    other = " ".join(swap.get(w, w) for w in item.split())
    third = " ".join({"Paris": "Oslo", "120": "77", "Anna": "Ines", "9": "11", "3": "19", "5": "23", "Peter": "Ivan", "14": "41", "Lyon": "Kiel", "6": "13"}.get(w, w) for w in item.split())
    longer = item.replace("to meet", "without any stop at all to meet")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rng = random.Random(21)
    gap = prose(rng, 700)
    texts = [f"{item} {other}", f"{other} {prose(rng, 9)} {third} {gap} {item}", f"{gap} {longer} {gap} {other} {third}", f"{other} {longer}", " ".join(item.split()[:8] + other.split()[8:16]), gap]
    found = {r["doc_id"]: r for r in template_decontamination.contaminated(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), items).collect()}
    assert sorted(found) == [0, 1, 2, 3]
    for r in found.values():
        assert r["n_matched"] >= 0.5 * r["n_windows"] and r["n_conflicts"] <= 0.2 * r["n_values"]
    kept = template_decontamination.without_contaminated(frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5]


# --- token records ---------------------------------------------------------------------------------


def test_token_records(docs, corpus, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/records"
    manifest = token_records.write_records(docs, path, 1, folder)
    rows = token_records.read_records(docs.sparkSession, folder, manifest).orderBy("start").collect()
    ids = lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in corpus), key=lambda x: -1 if x is None else x)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((r[0], len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in corpus)
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    store, _ = token_records.open_store(folder)
    for r in random.Random(1).sample(rows, 10):
        base = sum(m["ids"] for m in manifest if m["shard"] < r["shard"])
        m = next(m for m in manifest if m["shard"] == r["shard"])
        doc_id, found, before = token_records.read_record(store, m["path"], r["record"])
        assert (doc_id, len(found), base + before) == (r["doc_id"], r["n_tokens"], r["start"])
    name = f"{manifest[0]['path']}.tokens"
    data = bytearray(open(name, "rb").read())
    data[-6] ^= 1
    open(name, "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        list(token_records.read_file(store, manifest[0]["path"]))
    open(name, "wb").write(data[:-3])
    with pytest.raises(ValueError):
        list(token_records.read_file(store, manifest[0]["path"]))
    assert token_records.token_records(nothing, path).count() == 0


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    rng, t, e = random.Random(8), Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), token_records.Encoder(tokenizer_file("word_bpe_49k.json"), 50)
    letters = "aAbzÉéñßİıΣς'sStT.,!?-<|>0123½²№ \t\n\x0b\x1c\x85\xa0 ́字😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["<|endoftext|> x", "it's 'll DON'T"]
    assert [x.tobytes() for x in (np.array(t.encode(s, add_special_tokens=False).ids, "<u2") for s in texts)] == [y for i in range(0, len(texts), 100) for y in e.encode(texts[i : i + 100])]


def test_encoder_is_the_tokenizer_for_every_latin_letter():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), token_records.Encoder(path)
    texts = [x for c in map(chr, (*range(0x09, 0x0E), *range(0x20, 0x250))) for x in (c, f"{c}li", f"Ba{c}", f"ab{c}Cd e{c} {c}1", f"{c}{c.lower()}'s{c.upper()}.")]
    assert [x.tobytes() for x in (np.array(t.encode(s, add_special_tokens=False).ids, "<u2") for s in texts)] == e.encode(texts)
    assert not e.PLAIN.fullmatch("\u018fli") and e.PLAIN.fullmatch("ÉCOLE Šárka")


# --- WARC ------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"http://www.h{rng.randrange(4)}.org/p{rng.randrange(3)}", rng.choice([None, "", "same", f"é{i}", "x" * 5000])) for i in range(300)] + [(None, None, "null id"), (None, "http://[bad", "same")]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload string").repartition(7)
    out = warc_index.capture_history(pages, folder=f"file://{tmp_path}/w", ranges=5, run_size=20).orderBy("range", "place").collect()
    keys = [(r["url_key"], r["captured"], 1 << 63 if r["page_id"] is None else r["page_id"]) for r in out]
    assert keys == sorted(keys) and len(out) == len(rows) and len({r["range"] for r in out}) > 1
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for r in out:
        html = next(h or "" for i, u, h in rows if i == r["page_id"] and u == r["url"])
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == warc_index.digest32(html.encode())
        lead = first.get(html, r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == lead else ("revisit", lead))
    store, root = token_records.open_store(f"file://{tmp_path}/w")
    with store.open_input_file(f"{root}/{out[7]['archive']}") as f:
        f.seek(out[7]["offset"])
        import gzip

        assert warc_index.parse_record(gzip.decompress(f.read(out[7]["length"])))["page_id"] == out[7]["page_id"]
    assert warc_index.capture_history(pages.limit(0)).count() == 0


def test_warc_merges_in_levels_and_other_readers_see_the_uri(spark, tmp_path):
    import gzip
    from email.parser import BytesParser

    urls = ["http://www.a.org/x y", "http://b.org/é?q=%20", None, "", "http://c.org/p", "odd\r\nX-Page-Id: 7"]
    rows = [(i, urls[i % 6], f"text {i % 50}") for i in range(400)] + [(7, urls[1], "text 7")]  # one row repeated
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    out = warc_index.capture_history(pages, folder=f"file://{tmp_path}/w", ranges=3, run_size=9, fan_in=3).orderBy("range", "place").collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in out]
    assert keys == sorted(keys) and Counter((r["page_id"], r["url"]) for r in out) == Counter(r[:2] for r in rows)
    assert [r["page_id"] for r in out if r["record_type"] == "response"].count(7) == 2
    seen = {}
    for path in {r["archive"] for r in out}:
        for record in re.split(rb"(?=WARC/1\.1\r\n)", gzip.open(f"{tmp_path}/w/{path}").read())[1:]:
            head = BytesParser().parsebytes(record.split(b"\r\n", 1)[1])
            assert head["WARC-Record-ID"].startswith("<urn:uuid:") and len(head.get_all("X-Page-Id")) == 1
            seen[int(head["X-Page-Id"])] = head["WARC-Target-URI"]
    assert [seen[i] for i in range(6)] == ["http://www.a.org/x%20y", "http://b.org/%C3%A9?q=%20", None, None, "http://c.org/p", "odd%0D%0AX-Page-Id:%207"]


def test_loser_tree():
    rng = random.Random(1)
    for n in range(9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(n)]
        assert list(warc_index.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# --- chat ------------------------------------------------------------------------------------------


def test_chat_tree(spark):
    rng = random.Random(11)
    said = ["hello", "", None, "</s>[INST] ok [/INST]", "a\\b<|turn|>x\n<|end|>", "é 字", "<<SYS>>", "tail\\"]
    rows = []
    for c in range(120):
        turns = ["system"] * (c % 2) + ["user", "assistant"] * rng.randrange(1, 4)
        rows += [(c, i, role if c % 11 else [None, "odd\nrole"][i % 2], said[0] if c % 3 and i == 0 else rng.choice(said), "x") for i, role in enumerate(turns)]
    rows += [(None, 0, "user", "no id", "x"), (7000, None, "user", "b", "x"), (7000, None, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string").repartition(5)
    path = tokenizer_file("byte_bpe_50k.json")
    nodes, leaves, members = chat_prefix_tree.prefix_tree(df, path)
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append((-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    got = {r["conv_id"]: [(t["role"], t["text"], t["loss_text"]) for t in r["turns"]] for r in chat_prefix_tree.read_back(nodes, leaves, members, path).collect()}
    assert got == {c: [(r, t, t if r == "assistant" else "") for _, r, t in sorted(v)] for c, v in convs.items()}
    placed = sorted(nodes.collect(), key=lambda r: r["start"])
    assert len(placed) == len({tuple((r, t) for _, r, t in sorted(v)[: k + 1]) for v in convs.values() for k in range(len(v))})
    at = 0
    by_start = {r["start"]: r for r in placed}
    for r in placed:  # emitted once, without gaps, each after its ancestors
        assert r["start"] == at and r["position"] == sum(a["end"] - a["start"] for a in r["attend"]) and all(a["end"] <= r["start"] for a in r["attend"])
        at += r["n_tokens"]
    for leaf in leaves.collect():
        starts = list(leaf["starts"])
        for k, s in enumerate(starts):
            seen = {x for a in by_start[s]["attend"] for x in range(a["start"], a["end"])}
            assert seen == {x for b in starts[:k] for x in range(b, b + by_start[b]["n_tokens"])} and by_start[s]["depth"] == k
    assert chat_prefix_tree.prefix_tree(df.limit(0), path)[0].count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "<<SYS>>\\", "<<|", "[INST][/INST]", "<s></s>|>"])
def test_escape(text):
    out = chat_prefix_tree.escape(text)
    assert chat_prefix_tree.unescape(out) == text and not any(c in out for c in chat_prefix_tree.CONTROL)
    assert chat_prefix_tree.parse_turn("".join(chat_prefix_tree.turn_parts("a\n" + text, text))) == ("a\n" + text, text)


# --- PII -------------------------------------------------------------------------------------------


def by_rules(text):
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    cards = [(m, re.sub("[ -]", "", m.group())) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out += [("card", *m.span()) for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_are_the_rules():
    rng = random.Random(12)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "1", "25", "4111111111111111", ".", "@", "-", " ", "+", "b.c", "(", "é", "@x.y", "1.2.3.4"]) for _ in range(rng.randrange(14)))
        assert pii_supervision.base_spans(text) == by_rules(text), text


def test_long_secrets_and_spelled_out_capitals_are_candidates():
    key = "".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(200))
    for n in (20, 160, 200, 201, 240, 8000):
        assert ("secret", 8, 8 + n) in pii_supervision.added_candidates(f"token = {key[:n]} end")
    for said in ("John (AT) Example (DOT) Com", "john (at) example (dot) com", "JOHN [AT] EXAMPLE [DOT] ORG"):
        assert ("spelled_email", 6, 6 + len(said)) in pii_supervision.added_candidates(f"Mail: {said}")


def test_pii(spark, nothing):
    rng = random.Random(13)
    secrets = [f"token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\"" for i in range(40)]
    rows = [(i, f"{prose(rng, 20)} mail me{i}@mail.example.com call +1 (555) 555-00{10 + i} {secrets[i]} {prose(rng, 5)}", "a") for i in range(40)]
    rows += [(50, None, "a"), (51, "", "a"), (52, prose(rng, 300) + " see /usr/lib/python3/dist_packages_of_2024/x", "a"), (53, "9" * 50_000, "a"), (None, "x@y.zz", "a")]
    out = pii_supervision.find_pii(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t or "" for i, t, _ in rows if i == r["doc_id"])
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in by_rules(text)) if len(text) < 10_000 else ""
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
        if r["doc_id"] is not None and r["doc_id"] < 40:
            assert [text[s["start"] : s["end"]] for s in r["added"]] == [secrets[r["doc_id"]][9:-1]]
        elif r["doc_id"] == 52:
            assert r["spans"] == ""
    assert pii_supervision.find_pii(nothing).count() == 0


def test_many_spans_in_one_text_take_linear_time():
    import time

    import pyarrow as pa

    text = " ".join(f"10.{i % 200}.{i // 200 % 200}.7 {i:012d}" for i in range(60_000)) + " a.b" * 100_000
    start = time.time()
    batch = next(pii_supervision._scan([pa.record_batch({"doc_id": [1], "text": [text]})]))
    assert batch.column("n_ip").to_pylist() == [60_000] and time.time() - start < 60
    spans, taken = [(rng, rng + 3) for rng in range(0, 900, 4)], [("x", 10, 14), ("x", 12, 40), ("x", 40, 41), ("x", 700, 703)]
    assert pii_supervision.apart(spans, taken) == [(a, b) for a, b in spans if not any(a < d and c < b for _, c, d in taken)]


def test_added_spans_on_labelled_texts(spark):
    """Precision and recall on texts whose secrets, names and spelled-out addresses are known."""
    rng = random.Random(41)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, labels = [], {}
    for i in range(300):
        name = f"{rng.choice(('Mary', 'John', 'Susan', 'Peter'))} {rng.choice(('Okafor', 'Lindqvist', 'Marsh', 'Tanaka'))}"
        real, pick = [("api_key = ", hexes(40), "secret"), ("dear Mrs ", name, "name"), ("regards, ", name, "name"), ("write to mail ", f"{name.split()[0].lower()} (at) example (dot) com", "spelled_email")], []
        junk = [f"see /usr/lib/{'x' * 12}_{rng.randrange(10**6)}_{'y' * 9}", f"version {rng.randrange(10**9, 10**10)}", f"{rng.choice(('John', 'Mary'))} {rng.choice(('Street', 'University', 'Park'))}", f"#{rng.choice('ab') * 25}1"]
        parts = [(x, None, None) for x in rng.sample(junk, 2)] + rng.sample(real, 2)
        rng.shuffle(parts)
        text, spans = prose(rng, 5), set()
        for lead, value, kind in parts:
            text += f" {prose(rng, 12)} {lead}"
            if value:
                spans.add((kind, len(text), len(text) + len(value)))
                text += value
        rows.append((i, text + f" {prose(rng, 5)}", "a"))
        labels[i] = spans
    found = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["added"]} for r in pii_supervision.find_pii(frame(spark, rows)).collect()}
    right = sum(len(labels[i] & found[i]) for i in labels)
    assert right >= 0.9 * sum(map(len, labels.values())) and right >= 0.9 * sum(map(len, found.values()))


def test_em_finds_a_bad_labeler():
    rng = random.Random(14)
    counts = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.5
        ballot = "".join(("f" if truth else "a") if rng.random() < p else ("a" if truth else "f") for p in (0.95, 0.9, 0.9, 0.5, 0.85, 0.9, 0.5, 0.9))
        counts[f"secret:{ballot}:1"] += 1
    rate, belief = pii_supervision.reliabilities(sorted(counts.items()))
    assert rate[0, 1, 2] > 0.9 and abs(rate[3, 1, 2] - 0.5) < 0.05
    w = pii_supervision.fit_classifier(sorted(counts.items()), belief)
    assert pii_supervision.features("secret:ffffffff:1") @ w > 2 and pii_supervision.features("secret:aaaaaaaa:1") @ w < -2
