r"""Chat formatting as a prefix tree in depth-first order.

Conversations that begin with the same turns share those turns' tokens.  The tree's
depth-first order is the order of the conversations' paths (arrays of turn hashes): a
path's nodes beyond the prefix it shares with the path before it are new, and are
emitted there, once.  So equal conversations are merged (with map-side aggregation), paths are
range-sorted, each partition emits its nodes with local offsets in one streaming
pass, and the partitions' edges (first and last path, total length) give the global
offsets and the ancestors that reach over a partition's border.

Every node has ``start`` (offset of its first token in the packed stream), ``position``
(position id of that token: the tokens of its ancestors), ``attend`` (intervals of the stream
that it may attend to: its ancestors, adjacent ones merged; inside the node
attention is causal), token ids and the loss interval.

Template: ``<|turn|>role\ntext<|end|>\n``.  In roles and texts a backslash is doubled and every control string is
broken by a backslash after its first character (a line break in a role gets one
before it), so marks are unambiguous and ``unescape`` restores the text exactly.
Token ids come from a byte-level tokenizer, part by part, so the loss interval of
an assistant turn covers its text and nothing else.

Cases: null text or role is empty; a null turn sorts first; turns with equal numbers go by role and
text; a row with a null conv_id is a conversation of its own; an empty table gives no nodes; further
columns are not looked at.  One conversation must fit in a task, as in training; a turn may be very long.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import materialise

#: Strings that structure chat texts; they may not appear in a turn unescaped.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURN, END = "<|turn|>", "<|end|>\n"
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PARTS = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END), re.S)
PATHS = "key string, path array<string>, tokens array<binary>, loss_from array<int>, loss_to array<int>"
EMITTED = "part long, kind string, row long, depth int, key string, start long, position long, n_tokens long, tokens binary, loss_from int, loss_to int, starts array<long>, ends array<long>, first_path array<string>, last_path array<string>, head_ends array<long>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and end of a formatted turn."""
    return TURN + escape(role).replace("\n", "\\\n") + "\n", escape(text), END


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _PARTS.fullmatch(formatted)
    if not found:
        raise ValueError(f"not a turn: {formatted[:60]!r}")
    return unescape(found[1]), unescape(found[2])


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


#: Rows that are Python objects at a time in a worker.
SLICE = 200


def _encode(path: str):
    from nameloom.llm.wordhash import release

    def rows(batches):
        t = tokenizer(path)
        short: dict[str, np.ndarray] = {}

        def ids(part: str) -> np.ndarray:
            if part not in short:
                short[part] = np.array(t.encode(part, add_special_tokens=False).ids, dtype="<u4")
            return short[part]

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                found = batch.slice(at, SLICE)
                tokens, loss_from, loss_to = [], [], []
                for turns in found.column("turns").to_pylist():
                    parts = [turn_parts(x["role"], x["text"]) for x in turns]
                    bodies = [np.array(t.encode(p[1], add_special_tokens=False).ids, dtype="<u4") for p in parts]
                    if len(short) > 10_000:
                        short.clear()
                    heads, end = [ids(p[0]) for p in parts], ids(END)
                    spoken = [x["role"] == "assistant" for x in turns]
                    tokens.append([np.concatenate([h, b, end]).tobytes() for h, b in zip(heads, bodies)])
                    loss_from.append([len(h) if s else 0 for h, s in zip(heads, spoken)])
                    loss_to.append([len(h) + len(b) if s else 0 for h, b, s in zip(heads, bodies, spoken)])
                yield pa.record_batch(
                    [found.column("key"), found.column("path"), pa.array(tokens, pa.list_(pa.binary())), pa.array(loss_from, pa.list_(pa.int32())), pa.array(loss_to, pa.list_(pa.int32()))],
                    names=["key", "path", "tokens", "loss_from", "loss_to"],
                )
        release()

    return rows


def common_prefix(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _blank(part: int, kind: str, **more) -> dict:
    return {name.split(" ")[0]: None for name in EMITTED.split(", ")} | {"part": part, "kind": kind} | more


def _emitted(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.record_batch({name: pa.array([r[name] for r in rows], kinds[kind]) for name, kind in (x.split(" ") for x in EMITTED.split(", "))})


def _walk(batches):
    """Sorted paths of one partition to nodes, leaves and one edge row, with local offsets."""
    from pyspark import TaskContext

    part, at, number = TaskContext.get().partitionId(), 0, 0
    last: list[str] = []
    stack: list[tuple[int, int]] = []
    first_path, head_ends = None, None
    for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
        out = []
        for row in batch.to_pylist():
            shared = common_prefix(last, row["path"])
            del stack[shared:]
            position = sum(e - s for s, e in stack)
            for depth in range(shared, len(row["path"])):
                raw = row["tokens"][depth]
                n = len(raw) // 4
                out.append(_blank(part, "node", row=number, depth=depth, start=at, position=position, n_tokens=n, tokens=raw, loss_from=row["loss_from"][depth], loss_to=row["loss_to"][depth], starts=[s for s, _ in stack], ends=[e for _, e in stack]))
                stack.append((at, at + n))
                at, position = at + n, position + n
            last = row["path"]
            if first_path is None:
                first_path, head_ends = last, [e for _, e in stack]
            out.append(_blank(part, "leaf", row=number, key=row["key"], starts=[s for s, _ in stack], ends=[e for _, e in stack]))
            number += 1
        yield _emitted(out)
    if first_path is not None:
        yield _emitted([_blank(part, "edge", n_tokens=at, starts=[s for s, _ in stack], ends=[e for _, e in stack], first_path=first_path, last_path=last, head_ends=head_ends)])


def partition_shifts(edges: list) -> list[tuple]:
    """(part, base, cut, shared, starts, ends) from the edge rows in order.

    ``shared`` nodes at the head of a partition, ``cut`` tokens, were emitted before it, at (starts, ends).
    """
    out, base, last, stack = [], 0, [], []
    for e in edges:
        shared = common_prefix(last, e["first_path"])
        cut = e["head_ends"][shared - 1] if shared else 0
        known = stack[:shared]
        out.append((e["part"], base, cut, shared, [s for s, _ in known], [x for _, x in known]))
        stack = [known[d] if s < cut else (s - cut + base, x - cut + base) for d, (s, x) in enumerate(zip(e["starts"], e["ends"]))]
        base, last = base + e["n_tokens"] - cut, e["last_path"]
    return out


def prefix_tree(turns: DataFrame, tokenizer_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, leaves, members) of ``turns`` (conv_id, turn, role, text).

    nodes: start, position, n_tokens, depth, attend, tokens, loss_from, loss_to.
    leaves: key, starts (of the conversation's nodes in order).  members: conv_id, key.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    rows = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).unionByName(alone)
    rows = rows.withColumn("path", F.transform("turns", lambda t: F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))))
    rows = materialise(rows.withColumn("key", F.md5(F.array_join("path", ""))), "conversations")
    distinct = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("turns").alias("turns"))
    # dealt out before encoding, so that the sample for the ranges costs no tokenizer work
    ordered = distinct.repartitionByRange("path").sortWithinPartitions("path")
    emitted = materialise(ordered.mapInArrow(_encode(tokenizer_path), PATHS).mapInArrow(_walk, EMITTED), "prefix-tree")
    edges = emitted.where("kind = 'edge'").orderBy("part").collect()  # one row per partition
    shifts = turns.sparkSession.createDataFrame(partition_shifts(edges), "part long, base long, cut long, shared int, known_starts array<long>, known_ends array<long>")
    shifted = emitted.where("kind <> 'edge'").join(F.broadcast(shifts), "part")

    move = lambda array, known: F.transform(array, lambda s, d: F.when(d < F.col("_reach"), F.get(known, d)).otherwise(s - F.col("cut") + F.col("base")))
    # of a row's ancestors, those before the cut are the known ones; they are its first, by depth
    shifted = shifted.withColumn("_reach", F.size(F.filter("starts", lambda s: s < F.col("cut"))))
    shifted = shifted.withColumn("_starts", move("starts", F.col("known_starts"))).withColumn("_ends", move("ends", F.col("known_ends")))
    spans = F.arrays_zip(F.col("_starts").alias("start"), F.col("_ends").alias("end"))
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start: bigint, end: bigint>>"),
        lambda a, s: F.when(F.get(a, F.size(a) - 1)["end"] == s["start"], F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), s["end"].alias("end"))))).otherwise(F.concat(a, F.array(s))),
    )
    fresh = (F.col("row") > 0) | (F.col("depth") >= F.col("shared"))
    nodes = shifted.where("kind = 'node'").where(fresh).select((F.col("start") - F.col("cut") + F.col("base")).alias("start"), "position", "n_tokens", "depth", merged.alias("attend"), "tokens", "loss_from", "loss_to")
    leaves = shifted.where("kind = 'leaf'").select("key", F.col("_starts").alias("starts"))
    return nodes, leaves, rows.select("conv_id", "key")


def _decode(path: str):
    from nameloom.llm.wordhash import release

    def rows(batches):
        t = tokenizer(path)
        for whole in batches:
            for batch in (whole.slice(i, SLICE) for i in range(0, len(whole), SLICE)):
                out: dict[str, list] = {n: [] for n in ("role", "text", "loss_text", "chars")}
                for raw, a, b in zip(*(batch.column(c).to_pylist() for c in ("tokens", "loss_from", "loss_to"))):
                    ids = np.frombuffer(raw, dtype="<u4")
                    formatted = t.decode(ids.tolist(), skip_special_tokens=False)
                    role, text = parse_turn(formatted)
                    loss = t.decode(ids[a:b].tolist(), skip_special_tokens=False) if b > a else ""
                    for name, value in (("role", role), ("text", text), ("loss_text", unescape(loss)), ("chars", len(formatted))):
                        out[name].append(value)
                yield pa.record_batch({"start": batch.column("start"), "role": pa.array(out["role"], pa.string()), "text": pa.array(out["text"], pa.string()), "loss_text": pa.array(out["loss_text"], pa.string()), "chars": pa.array(out["chars"], pa.int64())})
        release()

    return rows


def read_back(nodes: DataFrame, leaves: DataFrame, members: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, turns (array of role, text, loss_text, chars) decoded from the nodes' tokens."""
    decoded = nodes.select("start", "tokens", "loss_from", "loss_to").mapInArrow(_decode(tokenizer_path), "start long, role string, text string, loss_text string, chars long")
    steps = leaves.select("key", F.posexplode("starts").alias("depth", "start"))
    paths = steps.join(decoded, "start").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text", "loss_text", "chars"))).alias("turns"))
    return members.join(paths, "key").select("conv_id", "turns")


def digests(read: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["chars"]).alias("formatted_chars"),
    )
