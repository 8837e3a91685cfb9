"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct ``n``-word shingles (the whole sequence, if
it has fewer words).  Two documents link when 100 * |intersection| >= ``percent``
* |union|.

1. Equal texts become one class; the rest works on one text of each class.
2. Shingles are hashed to 64 bits in batches.  Every batch sends fingerprints of its
   shingles (``SPARE_BITS`` more bits than their number has, so that few are equal by chance at any size), packed and compressed, to buckets by range; a bucket counts
   in how many documents each occurs and returns those of two documents or more to
   the batches that sent them.  Fingerprints that one batch has more than
   ``DENSE`` times travel as a count, and their places come back from the batch
   itself, so a shingle that a third of all documents hold is one entry per batch.
3. The global order is (document frequency, fingerprint).  Of a set of size s,
   the first s - ceil(percent/100 * s) + 1 shingles are its prefix: linked sets
   share a shingle there.  Shingles of frequency one join nothing, so most
   documents are done here; the others keep the shared part of their prefix.
4. Documents with the same size and the same shared prefix form a group.
5. Group pairs: each (shingle, size class) list is first compared with one
   member only, the one with the fewest shingles of its own (the text that its near
   copies were made from, if there is one); then entries outside their
   list's largest component are compared with one member of it.  After verification and connected components, the pairs
   left are those of one list whose components differ; they are made from the
   lists' smaller components only, filtered by size, by position (what two sets
   can still share if a shingle is their first common one) and by parity sketches (which
   differ in no more bits than the sets in shingles; a group's members may be as far from
   its sketch as the farthest is), expanded to members, filtered by their own sketches and
   verified: first each document with its nearest partner and with the least one by name, then,
   of the other pairs, those that these links leave in different components.  Pairs inside one component need no further check, since the result is
   the component of each document.  So no link between different texts is lost,
   and a group of thousands of copies costs a multiple of its size.
6. Verification compares the full 64-bit sets.

Cases: null or word-less texts have empty sets and link with nothing; equal
texts link if their set is not empty; rows with a null doc_id join like others but
never name a component unless all its rows are null; rows repeating a
doc_id are compared by text; an empty table gives an empty result; further columns
are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import by_ids, connected_components, limit_batches, materialise

#: Entries of one fingerprint in one batch beyond which only their number is sent.
DENSE = 4
#: Bits of a fingerprint beyond the logarithm of the number of shingles.
SPARE_BITS = 14
#: Entries of a list that one task compares with the others of it.
LIST_SLICE = 2_000
#: Shingles that one counting task takes on average (documents have about one for 5 bytes).
BUCKET = 1_000_000
#: Characters of text, about, whose words are hashed at a time.
HASHED = 1 << 20
#: Rounds in which entries apart from their list's main component are compared with one of its members.
NEAR_ROUNDS = 1
#: Rounds in which each document of the pairs left is compared with two of its partners, before the rest is.
HOOK_ROUNDS = 2
#: Longs of 64 bits in the parity sketch of a set.
SKETCH = 16
SHINGLES = "doc string, size long, private long, spare long, tokens array<long>"


def prefix_length(size: np.ndarray | int, percent: int):
    return size - (percent * size + 99) // 100 + 1


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z folded to lower case."""
    from nameloom.llm.wordhash import hash_words, mix, window_hashes

    piece = np.cumsum([len(t or "") for t in texts], dtype=np.int64) // HASHED
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        w = hash_words(texts[lo:hi], fold_ascii=True)
        for i in range(len(w)):
            h = w.of(i)
            if 0 < len(h) < n:
                total = window_hashes(h, len(h)) + np.uint64(len(h))
                out.append(mix(total))
            else:
                out.append(np.unique(window_hashes(h, n)))
    return out


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize)  # byte by byte, as high bytes are mostly zero
    return zstandard.ZstdCompressor(level=1).compress(planes.T.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=np.uint8)  # the frame states its size
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


COLUMNS = ("bucket", "batch", "docs", "sizes", "fps", "marks")
SCHEMA = "bucket long, batch long, docs binary, sizes binary, fps binary, marks binary"


def _batch_row(bucket: int, batch: int, docs=None, sizes=None, fps=None, marks=None) -> dict:
    """docs and sizes: only in a batch's own row.  fps: sorted, as differences.  marks: places, counts or frequencies."""
    return dict(zip(COLUMNS, (bucket, batch, docs, sizes, _pack(np.diff(fps, prepend=fps.dtype.type(0))) if fps is not None else None, _pack(marks) if marks is not None else None)))


def _fps(row) -> np.ndarray:
    return np.cumsum(_unpack(row["fps"], np.uint64), dtype=np.uint64)


def _table(rows: list[dict]) -> pa.Table:
    kinds = dict(zip(COLUMNS, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())))
    return pa.table({c: pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()})


def _send(n: int, buckets: int, bits: int):
    """Texts to rows for the buckets: entries (fingerprint, place), negative places being counts."""
    from nameloom.llm.wordhash import release, text_pieces

    def rows(batches):
        from pyspark import TaskContext

        batch_no = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            docs = batch.column("doc").to_pylist()
            for lo, hi, texts in text_pieces(batch.column("text"), 4 << 20):
                sets = shingle_sets(texts, n)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                sets = [np.unique(s >> np.uint64(64 - bits)) for s in sets]
                own = np.array([len(s) for s in sets], dtype=np.int64)
                fps = np.concatenate([*sets, np.empty(0, dtype=np.uint64)])
                place = np.repeat(np.arange(len(sets), dtype=np.int32), own)
                del sets, texts
                order = np.argsort(fps, kind="stable")
                fps, place = fps[order], place[order]
                del order
                starts = np.flatnonzero(np.diff(fps, prepend=fps[:1] ^ np.uint64(1))) if len(fps) else np.empty(0, dtype=np.int64)
                counts = np.diff(np.append(starts, len(fps)))
                dense = np.repeat(counts > DENSE, counts)
                out_fps = np.concatenate([fps[~dense], fps[starts[counts > DENSE]]])
                out_mark = np.concatenate([place[~dense], -counts[counts > DENSE].astype(np.int32)])
                order = np.argsort(out_fps, kind="stable")
                out_fps, out_mark = out_fps[order], out_mark[order]
                out = [_batch_row(hash(batch_no) % buckets, batch_no, docs="\n".join(docs[lo:hi]).encode(), sizes=np.stack([sizes, own]).tobytes(), fps=fps[dense], marks=place[dense])]
                cuts = np.searchsorted(out_fps, np.array([(i << bits) // buckets for i in range(1, buckets)], dtype=np.uint64))
                for b, (f, m) in enumerate(zip(np.split(out_fps, cuts), np.split(out_mark, cuts))):
                    if len(f):
                        out.append(_batch_row(b, batch_no, fps=f, marks=m))
                yield from _table(out).to_batches()
                batch_no += 1
            release()

    return rows


def _count(table: pa.Table) -> pa.Table:
    """Of one bucket: entries in two documents or more go back to their batches, with the frequency."""
    from nameloom.llm.wordhash import release

    rows = table.to_pylist()
    out = [r for r in rows if r["docs"] is not None]
    rows = [r for r in rows if r["docs"] is None]
    if not rows:
        return _table(out)
    parts = [(r["batch"], _fps(r), _unpack(r["marks"], np.int32)) for r in rows]
    fps, mark = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    known, where = np.unique(fps, return_inverse=True)
    df = np.bincount(where, weights=np.maximum(1, -mark.astype(np.int64)), minlength=len(known)).astype(np.int64)
    at = 0
    for batch, f, m in parts:
        own = df[where[at : at + len(f)]]
        at += len(f)
        if (shared := own > 1).any():
            out.append(_batch_row(-1, batch, fps=f[shared], marks=np.concatenate([m[shared].astype(np.int64), own[shared]])))
    del rows, parts, fps, mark, known, where, df
    release()
    return _table(out)


def _prefixes(percent: int):
    """Of one batch: each document's size and the shared part of its prefix in the global order."""
    from nameloom.llm.wordhash import release

    def rows(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        head = next(r for r in got if r["docs"] is not None)
        docs = head["docs"].decode().split("\n")
        sizes, own = np.frombuffer(head["sizes"], dtype=np.int64).reshape(2, -1)
        dense_fps, dense_place = _fps(head), _unpack(head["marks"], np.int32)
        all_fps, all_place, all_df = [], [], []
        for r in got:
            if r["docs"] is not None:
                continue
            f, (mark, df) = _fps(r), _unpack(r["marks"], np.int64).reshape(2, -1)
            single = mark >= 0
            all_fps.append(f[single]), all_place.append(mark[single]), all_df.append(df[single])
            many = f[~single]
            lo, hi = np.searchsorted(dense_fps, many), np.searchsorted(dense_fps, many, side="right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist())] or [np.empty(0, dtype=np.int64)]).astype(np.int64)
            all_fps.append(dense_fps[at]), all_place.append(dense_place[at].astype(np.int64)), all_df.append(np.repeat(df[~single], hi - lo))
        tokens: list[list[int]] = [[] for _ in docs]
        private = own.copy()
        if all_fps:
            fps, place, df = np.concatenate(all_fps), np.concatenate(all_place), np.concatenate(all_df)
            order = np.lexsort((fps, df, place))
            fps, place = fps[order], place[order]
            bounds = np.searchsorted(place, np.arange(len(docs) + 1))
            shared = np.diff(bounds)
            private = own - shared
            keep = prefix_length(sizes, percent) - private  # entries of frequency one come first
            for i in np.flatnonzero((keep > 0) & (shared > 0)).tolist():
                tokens[i] = fps[bounds[i] : min(bounds[i] + keep[i], bounds[i + 1])].astype(np.int64).tolist()
            del fps, place, df, order
        del got, dense_fps, dense_place, all_fps, all_place, all_df
        release()
        return pa.table({"doc": docs, "size": pa.array(sizes, pa.int64()), "private": pa.array(private, pa.int64()), "spare": pa.array(sizes - own, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    return rows


def _sketch(full: np.ndarray) -> np.ndarray:
    """Parities of a set's shingles in 64 * ``SKETCH`` places: the bits of two sets differ at most as often as the sets do."""
    places = 64 * SKETCH
    return np.packbits(np.bincount((full % np.uint64(places)).astype(np.int64), minlength=places) & 1).view(np.int64)


def _apart(x: str, y: str):
    """In how many bits two sketches differ."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH)), F.lit(0))


def _set_rows(n: int):
    from nameloom.llm.wordhash import release, text_pieces

    def rows(batches):
        for batch in batches:
            for lo, hi, texts in text_pieces(batch.column("text")):
                full = shingle_sets(texts, n)
                yield pa.record_batch({"doc": batch.column("doc").slice(lo, hi - lo), "full": pa.array([s.tobytes() for s in full], pa.binary()), "sketch": pa.array([_sketch(s) for s in full], pa.list_(pa.int64()))})
        release()

    return rows


def _linked(percent: int):
    from nameloom.llm.wordhash import release

    def rows(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})
        release()

    return rows


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    x, y = sets.select(F.col("doc").alias("a"), F.col("full").alias("x")), sets.select(F.col("doc").alias("b"), F.col("full").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked(percent), "a string, b string")


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def fingerprint_bits(total_bytes: int) -> int:
    """Bits of a fingerprint: of 2**k shingles, about one in 2**SPARE_BITS equals another by chance."""
    return min(63, max(32, math.ceil(math.log2(total_bytes / 5 + 1)) + SPARE_BITS))


def shared_prefixes(texts: DataFrame, n: int, percent: int, total_bytes: int, bits: int | None = None) -> DataFrame:
    """(doc, size, tokens) of distinct ``texts`` (doc, text): tokens empty where nothing can link."""
    buckets = max(16, math.ceil(total_bytes / 5 / BUCKET))
    sent = texts.mapInArrow(_send(n, buckets, bits or fingerprint_bits(total_bytes)), SCHEMA)
    counted = sent.groupBy("bucket").applyInArrow(_count, SCHEMA)
    return counted.groupBy("batch").applyInArrow(_prefixes(percent), SHINGLES)


def _mixed_lists(lists: DataFrame, members: DataFrame, links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(doc, g, size, comp) of all members, and the entries, with comp and main, of lists with more than one component."""
    labels = materialise(connected_components(links, f"components-{turn}"), f"labels-{turn}")
    comp = members.join(labels, members["doc"] == labels["v"], "left").select("doc", "g", "size", F.coalesce("label", "doc").alias("comp"))
    comp = materialise(comp, f"member-components-{turn}")
    entries = lists.join(comp.select("g", "comp").distinct(), "g")
    per = entries.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("entries")).where("comps > 1").drop("comps")
    return comp, materialise(entries.join(main, "token"), f"mixed-lists-{turn}")


def candidate_links(sized: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect every component of ``sized`` (doc, size, private, spare, tokens)."""
    keys = ["size", "private", "spare", "tokens"]
    groups = sized.groupBy(*keys).agg(F.min("doc").alias("g"))
    members = materialise(sized.join(groups, keys).select("doc", "g", "size"), "prefix-members")
    # rest: the largest overlap with a set whose first common shingle is this entry
    lists = groups.select("g", "size", "private", "spare", F.posexplode("tokens").alias("at", "token"))
    lists = lists.select("g", "size", "token", (F.col("private") / F.col("size")).alias("own"), (F.col("size") - F.col("private") - F.col("at") + F.col("spare")).alias("rest"))
    lists = materialise(lists, "prefix-lists")

    def fits(x: str, y: str):
        """Of entries with sizes s and rests r: may the sets link, this being their first common shingle?"""
        s, t = F.col(f"s{x}"), F.col(f"s{y}")
        return (100 * F.least(s, t) >= percent * F.greatest(s, t)) & ((100 + percent) * F.least(f"r{x}", f"r{y}") >= percent * (s + t))

    # first comparisons: members with their group's first, and list entries with the list's most shared
    step = math.log(100 / percent) / 2
    classed = lists.withColumn("c", F.floor(F.log(F.col("size").cast("double")) / step)).withColumnsRenamed({"size": "s1", "rest": "r1"})
    center = F.min_by(F.struct("g", "s1", "r1"), F.struct("own", "g"))
    firsts = classed.groupBy("token", "c").agg(center.alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = firsts.select("token", "c", F.col("m.g").alias("first"), F.col("m.s1").alias("s2"), F.col("m.r1").alias("r2"))
    first_pairs = classed.join(firsts, ["token", "c"]).where("g <> first").where(fits("1", "2")).select(*_ordered(F.col("g"), F.col("first")))
    pairs = first_pairs.union(members.where("doc <> g").select(*_ordered(F.col("doc"), F.col("g")))).distinct()
    links = materialise(verified(pairs, sets, percent), "links-first")
    # entries outside their list's main component are compared with one of its members, another one in each list and round
    for turn in range(1, NEAR_ROUNDS + 1):
        comp, mixed = _mixed_lists(lists, members, links, turn)
        some = F.min_by(F.struct("g", "size", "rest"), F.xxhash64("g", "token", F.lit(turn)))
        inside = mixed.where("comp = main").groupBy("token").agg(some.alias("m")).select("token", F.col("m.g").alias("g2"), F.col("m.size").alias("s2"), F.col("m.rest").alias("r2"))
        tries = mixed.where("comp <> main").withColumnsRenamed({"size": "s1", "rest": "r1"}).join(inside, "token").where(fits("1", "2"))
        pairs = tries.select(*_ordered(F.col("g"), F.col("g2"))).distinct()
        links = materialise(links.union(verified(pairs, sets, percent)), f"links-{turn}")

    # what is left: entries of one list in different components
    comp, mixed = _mixed_lists(lists, members, links, NEAR_ROUNDS + 1)
    units = mixed.select("g", "comp").distinct()
    inside = materialise(comp.join(units, ["g", "comp"]).join(sets.select("doc", "sketch"), "doc").select("doc", "g", "comp", "size", "sketch"), "left-members")
    leads = inside.groupBy("g", "comp").agg(F.min_by("sketch", "doc").alias("lead"))
    leads = inside.join(leads, ["g", "comp"]).groupBy("g", "comp").agg(F.first("lead").alias("lead"), F.max(_apart("sketch", "lead")).alias("radius"))
    mixed = materialise(mixed.join(leads, ["g", "comp"]), "left-lists")

    def near(x: str, y: str, slack=F.lit(0)):
        """May sets with sketches x and y link, if these are up to ``slack`` bits off?"""
        return (100 + percent) * (_apart(x, y) - slack) <= (100 - percent) * (F.col("s1") + F.col("s2"))

    # a long list is dealt to several tasks: its entries are sliced on one side and meet copies of the other
    slices = F.ceil(F.col("entries") / LIST_SLICE).cast("int")
    small = mixed.where("comp <> main").select("token", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.col("g").alias("g1"), F.col("size").alias("s1"), F.col("rest").alias("r1"), F.col("comp").alias("c1"), F.col("lead").alias("x1"), F.col("radius").alias("o1"))
    every = mixed.select("token", F.pmod(F.xxhash64("g", "comp"), slices).cast("int").alias("slice"), F.col("g").alias("g2"), F.col("size").alias("s2"), F.col("rest").alias("r2"), F.col("comp").alias("c2"), (F.col("comp") == F.col("main")).alias("in_main"), F.col("lead").alias("x2"), F.col("radius").alias("o2"))
    apart = (F.col("c1") != F.col("c2")) & (F.col("in_main") | (F.col("c1") < F.col("c2")))
    left = small.join(every, (small["token"] == every["token"]) & (small["slice"] == every["slice"]) & apart & fits("1", "2") & near("x1", "x2", F.col("o1") + F.col("o2"))).select("g1", "c1", "g2", "c2").distinct()
    one, two = (inside.select(F.col("g").alias(f"g{i}"), F.col("comp").alias(f"c{i}"), F.col("doc").alias(f"d{i}"), F.col("size").alias(f"s{i}"), F.col("sketch").alias(f"x{i}")) for i in (1, 2))
    two = two.withColumnsRenamed({"g2": "_g2", "c2": "_c2"})
    first = left.join(one, ["g1", "c1"])
    expanded = first.join(two, (first["g2"] == two["_g2"]) & (first["c2"] == two["_c2"]) & near("x1", "x2")).select(*_ordered(F.col("d1"), F.col("d2")), _apart("x1", "x2").alias("far")).distinct()
    pairs = materialise(expanded, "left-pairs")
    for turn in range(1, HOOK_ROUNDS + 1):
        if pairs.isEmpty():
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
        chosen = both.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("nearest"), F.min("b").alias("least"))
        tries = chosen.select("a", F.explode(F.array("nearest", "least")).alias("b")).select(*_ordered(F.col("a"), F.col("b"))).distinct()
        tries = materialise(tries, f"hook-pairs-{turn}")
        links = materialise(links.union(verified(tries, sets, percent)), f"hook-links-{turn}")
        labels = materialise(connected_components(links, f"hook-components-{turn}"), f"hook-labels-{turn}")
        one, two = (labels.select(F.col("v").alias(x), F.col("label").alias(f"_{x}")) for x in "ab")
        rest = pairs.join(tries, ["a", "b"], "left_anti").join(one, "a", "left").join(two, "b", "left")
        pairs = materialise(rest.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b", "far"), f"hook-left-{turn}")
    return links.union(verified(pairs.select("a", "b"), sets, percent))


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class (md5 of the text) of every row of ``docs``."""
    limit_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    rows = texts.select("doc_id", "row", F.md5(F.coalesce("text", F.lit(""))).alias("doc"), F.octet_length("text").alias("bytes"))
    rows = materialise(rows, "join-rows")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    classes = rows.groupBy("doc").agg(F.min("doc_id").alias("first"), F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    later = materialise(rows.join(classes.select("doc", F.col("row").alias("_row")), "doc").where("row <> _row").select("row").distinct(), "join-copies")

    texts = texts.where("text is not null")
    distinct = by_ids(texts, later, "row", "left_anti").select(F.md5("text").alias("doc"), "text")
    sized = materialise(shared_prefixes(distinct, n, percent, total), "join-prefixes").dropDuplicates(["doc"])
    alive = materialise(sized.where("size(tokens) > 0"), "join-alive")
    wanted = materialise(classes.join(alive.select("doc"), "doc", "left_semi").select("row"), "join-wanted")
    full = by_ids(texts, wanted, "row", "left_semi").select(F.md5("text").alias("doc"), "text")
    sets = materialise(full.mapInArrow(_set_rows(n), "doc string, full binary, sketch array<long>"), "join-sets").dropDuplicates(["doc"])
    labels = connected_components(candidate_links(alive, sets, percent), "components-all")

    named = classes.select("doc", "first").join(labels, classes["doc"] == labels["v"], "left").select("doc", "first", F.coalesce("label", "doc").alias("label"))
    named = materialise(named, "join-labels")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    out = rows.select("doc_id", "doc").join(named.join(least, "label").select("doc", "component_id"), "doc").join(sized.select("doc", "size"), "doc", "left")
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_shingles"), F.when(size == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("doc").alias("class"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those whose component has a smaller doc_id; rows with a null doc_id stay."""
    found = components(docs, n, percent).where("component_id < doc_id").select(F.col("doc_id")).distinct()
    names = docs.columns
    return by_ids(docs, materialise(found, "join-gone"), "doc_id", "left_anti").select(*names)
