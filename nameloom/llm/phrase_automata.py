"""Substring dedup: sharded Aho-Corasick automata over recurring phrases, then exact window removal.

1. Every window of ``window`` words contains a smallest hash among its phrases of
   ``phrase`` words; equal windows have equal smallest phrases.  One pass leaves, per document
   with a window at all, the distinct smallest phrases of its windows (about 4 of 100
   positions), a key of its whole text, and its words as letters (two of 6 bits
   each, from alphabets of their own, so no node has more than 64 children and a match cannot begin inside a word).
2. Phrases that two different texts emit are confirmed as recurring.  Rows whose whole text stands
   under a smaller doc_id are copies and lose all their words at once.
3. The recurring phrases are dealt into shards of about ``SHARD`` by hash; each becomes one Aho-Corasick automaton, compiled
   once, written to the shared folder and named in a manifest of one row per shard.
4. All documents are streamed through the automata of all shards, ``LOADED`` of them in a worker at a time.  An
   occurrence is what an automaton reports; nothing else finds one.
5. Windows whose smallest phrase is an occurrence are hashed and
   grouped: a window first seen under a smaller doc_id marks its words in the others.
   Groups are aggregated before the shuffle, so a passage that a third of the
   documents hold is one row per task, not one list.

Step 4 reads the letters (2 bytes a word, before compression) once per ``LOADED`` shards, so its work grows with documents times
recurring phrases / (``SHARD`` * ``LOADED``): that is the method's price.

Windows are compared by 64-bit hash.  Cases: null text is empty; texts under
``window`` words lose nothing; a null doc_id counts as greater than all others;
rows with equal doc_ids do not remove each other's words; very long texts are streamed like any other; an empty table
gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import by_ids, materialise, n_words, new_folder, words

WINDOW, PHRASE = 50, 8
#: Phrases of one automaton (about 650 bytes each in memory), automata a worker holds at a time, and passes over the documents in one job.
SHARD, LOADED, PASSES = 100_000, 2, 32
LAST = (1 << 63) - 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _smallest(phrases: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive entries, by doubling."""
    low, have = phrases, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _letters(h: np.ndarray) -> np.ndarray:
    """Two bytes per word hash: 0x40-0x7F, then 0x80-0xBF."""
    out = np.empty(2 * len(h), dtype=np.uint8)
    out[0::2] = (h & np.uint64(63)) | np.uint64(0x40)
    out[1::2] = ((h >> np.uint64(20)) & np.uint64(63)) | np.uint64(0x80)
    return out


def _phrase_rows(window: int, phrase: int):
    from nameloom.llm.wordhash import hash_words, release, text_pieces, window_hashes

    def rows(batches):
        for batch in batches:
            ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "r"))
            for lo, hi, texts in text_pieces(batch.column("text")):
                at, whole, keys, letters = [], [], [], []
                w = hash_words(texts)
                for i in range(len(w)):
                    h = w.of(i)
                    if len(h) < window:
                        continue
                    p = window_hashes(h, phrase)
                    where = np.flatnonzero(np.isin(p, np.unique(_smallest(p, window - phrase + 1))))
                    where = where[np.unique(p[where], return_index=True)[1]]
                    said = _letters(h)
                    raw = said.tobytes()
                    keys.append([raw[2 * x : 2 * (x + phrase)] for x in where.tolist()])
                    letters.append(raw)
                    whole.append(int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True))
                    at.append(lo + i)
                if at:
                    yield pa.record_batch({"k": ids[at], "r": rids[at], "t": pa.array(whole, pa.int64()), "phrases": pa.array(keys, pa.list_(pa.binary())), "letters": pa.array(letters, pa.binary())})
        release()

    return rows


def prepared(keyed: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(k, r, t, phrases, letters) of the rows of ``keyed`` (k, r, text) with ``window`` words or more."""
    return keyed.mapInArrow(_phrase_rows(window, phrase), "k long, r long, t long, phrases array<binary>, letters binary")


def recurring_phrases(documents: DataFrame) -> DataFrame:
    """(phrase) that two different texts hold, each once."""
    said = documents.select("t", F.explode("phrases").alias("phrase"))
    return said.groupBy("phrase").agg(F.min("t").alias("one"), F.max("t").alias("other")).where("one < other").select("phrase")


def _compile(folder: str):
    def shard(key, table):
        import ahocorasick

        from nameloom.llm.token_records import open_store

        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for x in table.column("phrase").to_pylist():
            automaton.add_word(x.decode("latin-1"))
        automaton.make_automaton()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"automaton-{key[0].as_py()}-{uuid.uuid4().hex}"  # an attempt that is lost leaves a file that no manifest names
        data = pickle.dumps(automaton)
        with store.open_output_stream(f"{root}/{name}") as f:
            f.write(data)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "path": [name], "patterns": pa.array([table.num_rows], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return shard


def compile_automata(phrases: DataFrame, folder: str, per_shard: int = SHARD) -> list:
    """Manifest (shard, path, patterns, bytes) of the automata of ``phrases``, written to ``folder``."""
    shards = -(-phrases.count() // per_shard)
    if not shards:
        return []
    dealt = phrases.withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(shards)))
    return sorted(dealt.groupBy("shard").applyInArrow(_compile(folder), "shard long, path string, patterns long, bytes long").collect())  # one row per shard


_loaded: dict[str, object] = {}


def _automaton(folder: str, name: str):
    """An automaton of the manifest; a worker keeps the last ``LOADED``."""
    if name not in _loaded:
        from nameloom.llm.token_records import open_store

        while len(_loaded) >= LOADED:
            del _loaded[next(iter(_loaded))]
        store, root = open_store(folder)
        with store.open_input_file(f"{root}/{name}") as f:
            _loaded[name] = pickle.loads(f.read())
    return _loaded[name]


def _stream(folder: str, names: list[str], phrase: int):
    def rows(batches):
        for batch in batches:
            ids = batch.column("r").to_pylist()
            for name in names:
                automaton, found, at = _automaton(folder, name), [], []
                for r, letters in zip(ids, batch.column("letters")):
                    ends = np.fromiter((end for end, _ in automaton.iter(letters.as_buffer().to_pybytes().decode("latin-1"))), dtype=np.int32)
                    if len(ends):
                        found.append(r)
                        at.append((ends + 1) // 2 - phrase)
                if found:
                    yield pa.record_batch({"r": pa.array(found, pa.int64()), "shard": [name] * len(found), "at": pa.array(at, pa.list_(pa.int32()))})

    return rows


def occurrences(documents: DataFrame, folder: str, manifest: list, phrase: int = PHRASE) -> DataFrame:
    """(r, at): word positions of the documents (r, letters) where any automaton of ``manifest`` reports a phrase."""
    names = [m["path"] for m in manifest]
    groups = [names[i : i + LOADED] for i in range(0, len(names), LOADED)]
    schema = "r long, shard string, at array<int>"
    read = documents.select("r", "letters")
    rounds = []
    for i in range(0, len(groups), PASSES):
        passes = [read.mapInArrow(_stream(folder, g, phrase), schema) for g in groups[i : i + PASSES]]
        rounds.append(materialise(reduce(DataFrame.unionByName, passes), "occurrences"))
    found = reduce(DataFrame.unionByName, rounds) if rounds else documents.sparkSession.createDataFrame([], schema)
    once = found.groupBy("r", "shard").agg(F.first("at").alias("at"))  # repeated rows have the same occurrences
    return once.groupBy("r").agg(F.flatten(F.collect_list("at")).alias("at"))


def _window_rows(window: int, phrase: int):
    from nameloom.llm.wordhash import hash_words, release, text_pieces, window_hashes

    span, never = window - phrase + 1, np.uint64((1 << 64) - 1)

    def rows(batches):
        for batch in batches:
            ids, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "r"))
            hits = batch.column("at")
            for lo, hi, texts in text_pieces(batch.column("text")):
                found, docs, at = [], [], []
                w = hash_words(texts)
                for i in range(len(w)):
                    p = window_hashes(w.of(i), phrase)
                    heard = np.full(len(p), never)
                    where = hits[lo + i].values.to_numpy()
                    heard[where] = p[where]
                    own = np.unique(window_hashes(w.of(i), window)[_smallest(heard, span) == _smallest(p, span)])
                    found.append(own)
                    docs.append(np.full(len(own), ids[lo + i]))
                    at.append(np.full(len(own), rids[lo + i]))
                if found:
                    yield pa.record_batch({"w": _signed(np.concatenate(found)), "k": np.concatenate(docs), "r": np.concatenate(at)})
        release()

    return rows


def _removal_rows(window: int):
    from nameloom.llm.wordhash import hash_words, release, text_pieces, window_hashes

    def rows(batches):
        for batch in batches:
            for lo, hi, texts in text_pieces(batch.column("text")):
                out_n, out_removed, out_sha, out_kept = [], [], [], []
                marks = batch.column("marked").slice(lo, hi - lo)
                w = hash_words(texts)
                for i in range(len(w)):
                    h = w.of(i)
                    gone = np.zeros(len(h) + 1, dtype=np.int64)
                    if marks[i].is_valid and len(h) >= window:
                        at = np.flatnonzero(np.isin(window_hashes(h, window), marks[i].values.to_numpy().view(np.uint64)))
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1) if len(at) else None
                    covered = np.cumsum(gone)[:-1] > 0
                    kept = b" ".join(x for x, c in zip(w.word_bytes(i), covered.tolist()) if not c)
                    out_n.append(len(h))
                    out_removed.append(int(covered.sum()))
                    out_sha.append(hashlib.sha256(kept).hexdigest())
                    out_kept.append(kept.decode("utf-8", "surrogatepass"))
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_words": pa.array(out_n, pa.int64()), "n_removed": pa.array(out_removed, pa.int64()), "kept_sha256": out_sha, "kept_text": pa.array(out_kept, pa.string())})
        release()

    return rows


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every row of ``docs``."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k"), "text")
    keyed = keyed.withColumn("r", F.xxhash64("k", F.coalesce("text", F.lit(""))))  # rows with one doc_id may differ in text
    documents = materialise(prepared(keyed.select("k", "r", "text"), window, phrase), "phrase-documents")
    firsts = documents.groupBy("t").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last")
    copies = materialise(documents.select("t", "k", "r").join(firsts, "t").where("first < k").select("r").distinct(), "phrase-copies")

    phrases = materialise(recurring_phrases(documents), "recurring-phrases")
    folder = new_folder(spark, "automata")
    manifest = compile_automata(phrases, folder)
    hits = materialise(occurrences(by_ids(documents, copies, "r", "left_anti"), folder, manifest, phrase), "phrase-hits")

    touched = by_ids(keyed, hits.select("r"), "r", "left_semi")
    plain = by_ids(by_ids(keyed, hits.select("r"), "r", "left_anti"), copies, "r", "left_anti")
    kept = F.array_join(words(F.col("text")), " ")
    untouched = plain.select("doc_id", n_words(F.col("text")).alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"), kept.alias("kept_text"))

    windows = touched.join(hits, "r").select("k", "r", "text", "at")
    windows = materialise(windows.mapInArrow(_window_rows(window, phrase), "w long, k long, r long"), "windows")
    first = windows.groupBy("w").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first < last").drop("last")
    marked = windows.join(first, "w").where("first < k").groupBy("r").agg(F.collect_set("w").alias("marked"))
    originals = touched.select("doc_id", "r", "text").join(marked, "r", "left").select("doc_id", "text", "marked")
    cut = originals.mapInArrow(_removal_rows(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    gone = by_ids(keyed, copies, "r", "left_semi").select("doc_id", n_words(F.col("text")).alias("n_words"))
    empty = F.lit("").cast("string")
    gone = gone.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(empty, 256).alias("kept_sha256"), empty.alias("kept_text"))
    return untouched.unionByName(cut).unionByName(gone)
