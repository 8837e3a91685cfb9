"""Token-id output as length-delimited binary records with a separate offset index.

Data file (one per partition; partitions are ranges of doc_id, so the files in order are
sorted): records of

    length      u64 little-endian, bytes of the payload
    check 1     u32, masked CRC-32 of those eight bytes
    payload     doc_id i64, flags u8 (1: ids are u32, else u16; 2: doc_id is null), ids
    check 2     u32, masked CRC-32 of the payload

Index file: for each record its byte offset and the number of ids in the file before
it (two u64), so that a reader can seek to any record, or to any id, in any order.
Masking: rotate right by 15 bits, add a constant; so a file that holds
checksums of its own does not check by accident.

Files are written under a temporary name in the shared folder and renamed when whole, so
a task that is lost or runs twice leaves complete files only.  The driver keeps one
row per file.

Cases: null text is empty (one id, the end); rows with equal or null doc_ids
are all written (nulls first; ties by text); an empty table gives no file and no
rows; ids beyond 16 bits widen the record; further columns are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import limit_batches, new_folder

MASK = 0xA282EAD8
HEAD, PAYLOAD, ENTRY = struct.Struct("<QI"), struct.Struct("<qB"), struct.Struct("<QQ")
WIDE, NULL_ID = 1, 2
MANIFEST = "shard long, path string, records long, ids long, bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def open_store(folder: str):
    """(filesystem, path in it) of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class Encoder:
    """Ids of whole texts by a tokenizer file, as u16 or u32 bytes.

    For a tokenizer of the one kind described by ``WORDWISE`` (lower case; words found by
    a pattern that drops white space; BPE inside a word, whose last token bears an end mark),
    the ids of a text are those of its words, so words seen before come from a
    bounded table.  Texts with characters outside a plain range, or with the string of a
    special token, and all texts of other tokenizers are encoded whole.
    """

    #: The pattern of the tokenizer kind that is encoded word by word.
    WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: ASCII and the characters from U+00A1 to U+024F whose lower case is one character in this range (so U+0130 and, for example, U+018F are not).
    PLAIN = re.compile("[\t\n\r -~%s]*" % "".join(c for c in map(chr, range(0xA1, 0x250)) if len(c.lower()) == 1 and c.lower() <= "ɏ"))
    LETTERS = "a-zªµºÀ-ÖØ-öø-ɏ"
    DIGITS = "0-9²³¹¼-¾"
    WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t\n\r {LETTERS}{DIGITS}]+")

    #: Words that are encoded in one call, so that the tokenizer's own record of them stays small.
    LEARN = 10_000

    def __init__(self, path: str, table_size: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.table: dict[str, bytes] = {}
        self.table_size = table_size
        first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        self.wordwise = bool(suffix) and first.get("type") == "Split" and first.get("pattern") == {"Regex": self.WORDWISE} and first.get("invert") is True and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if self.wordwise:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
            self.model = self.tokenizer.model
            self.direct = [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"][1:]] in ([], ["ByteLevel"])
            raw, width = np.arange(len(self.ends), dtype=self.kind).tobytes(), self.kind.itemsize
            self.one = [raw[at : at + width] for at in range(0, len(raw), width)]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Enter words into the table.  Normaliser and pre-tokenizer leave a word of ASCII letters, or one digit, as it is, so it goes to the model itself."""
        if self.direct:
            tokenize, one, others = self.model.tokenize, self.one, []
            for word in missing:
                if word.isascii() and word.isalnum():
                    self.table[word] = b"".join([one[t.id] for t in tokenize(word)])
                else:
                    others.append(word)
            missing = others
        if not missing:
            return
        ids = np.array(self.tokenizer.encode(" ".join(missing), add_special_tokens=False).ids, dtype=self.kind)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(missing):
            raw, width, at = ids.tobytes(), self.kind.itemsize, 0
            for word, to in zip(missing, (cuts * width).tolist()):
                self.table[word] = raw[at:to]
                at = to
        else:
            self.table.update((word, self._whole(word)) for word in missing)

    def encode(self, texts: list) -> list[bytes]:
        """Bytes of the ids of each text (None: empty)."""
        if not self.wordwise:
            return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.table) > self.table_size:
            self.table.clear()
        out: list[bytes] = [b""] * len(texts)
        split, missing = {}, set()
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.PLAIN.fullmatch(text) and not self.special.search(text):
                split[i] = self.WORD.findall(text.lower())
                missing.update(split[i])
            else:
                out[i] = self._whole(text)
        missing = [w for w in missing if w not in self.table]
        for i in range(0, len(missing), self.LEARN):
            self._learn(missing[i : i + self.LEARN])
        for i, found in split.items():
            out[i] = b"".join(map(self.table.__getitem__, found))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def index_entry(offset: int, before: int) -> bytes:
    return ENTRY.pack(offset, before)


def record(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    payload = PAYLOAD.pack(doc_id or 0, WIDE * wide + NULL_ID * (doc_id is None)) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def _write(folder: str, tokenizer_path: str, end_id: int):
    from nameloom.llm.wordhash import release, text_pieces

    def rows(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        store, root = open_store(folder)
        enc = encoder(tokenizer_path)
        wide = enc.kind.itemsize == 4
        end = np.array([end_id], dtype=enc.kind).tobytes()
        name = f"{root}/part-{shard:06d}"
        records = ids = size = 0
        data = index = None
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for lo, hi, texts in text_pieces(batch.column("text")):
                out, entries = [], []
                for doc_id, raw in zip(docs[lo:hi], enc.encode(texts)):
                    entries.append(index_entry(size, ids))
                    out.append(record(doc_id, raw + end, wide))
                    size += len(out[-1])
                    ids += (len(raw) + len(end)) // enc.kind.itemsize
                    records += 1
                if data is None:
                    store.create_dir(root, recursive=True)
                    data, index = (store.open_output_stream(f"{name}.{kind}.{attempt}") for kind in ("tokens", "index"))
                data.write(b"".join(out))
                index.write(b"".join(entries))
            release()
        if data is not None:
            data.close(), index.close()
            for kind in ("index", "tokens"):
                store.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
        del enc  # an idle worker would keep the tokenizer and its table beside other stages' memory
        encoder.cache_clear()
        release()
        if data is not None:
            yield pa.record_batch({"shard": pa.array([shard], pa.int64()), "path": [name], "records": pa.array([records], pa.int64()), "ids": pa.array([ids], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return rows


def read_file(store, path: str, chunk: int = 4 << 20):
    """(doc_id, ids as an array) of each record of a data file, checksums verified."""
    with store.open_input_stream(f"{path}.tokens") as f:
        held, at = b"", 0
        while True:
            while len(held) - at >= HEAD.size:
                length, check = HEAD.unpack_from(held, at)
                if masked(held[at : at + 8]) != check:
                    raise ValueError(f"{path}: a length does not match its checksum")
                if len(held) - at < HEAD.size + length + 4:
                    break
                payload = held[at + HEAD.size : at + HEAD.size + length]
                if masked(payload) != int.from_bytes(held[at + HEAD.size + length : at + HEAD.size + length + 4], "little"):
                    raise ValueError(f"{path}: a payload does not match its checksum")
                doc_id, flags = PAYLOAD.unpack_from(payload)
                yield None if flags & NULL_ID else doc_id, np.frombuffer(payload, dtype="<u4" if flags & WIDE else "<u2", offset=PAYLOAD.size)
                at += HEAD.size + length + 4
            more = f.read(chunk)
            if not more:
                break
            held, at = held[at:] + more, 0
        if len(held) != at:
            raise ValueError(f"{path}: the last record is cut off")


def read_record(store, path: str, number: int):
    """(doc_id, ids, ids before it in the file) of one record, found through the index."""
    with store.open_input_file(f"{path}.index") as f:
        f.seek(number * ENTRY.size)
        offset, before = ENTRY.unpack(f.read(ENTRY.size))
    with store.open_input_file(f"{path}.tokens") as f:
        f.seek(offset)
        length, check = HEAD.unpack(head := f.read(HEAD.size))
        payload, end = f.read(length), f.read(4)
    if masked(head[:8]) != check or masked(payload) != int.from_bytes(end, "little"):
        raise ValueError(f"{path}: record {number} does not match its checksum")
    doc_id, flags = PAYLOAD.unpack_from(payload)
    return None if flags & NULL_ID else doc_id, np.frombuffer(payload, dtype="<u4" if flags & WIDE else "<u2", offset=PAYLOAD.size), before


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str) -> list:
    """Write the texts of ``docs`` in the order of doc_id; returns one manifest row per file, in order."""
    limit_batches(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.col("_t"), F.col("text")]
    rows = docs.select("doc_id", "text").withColumn("_t", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    return sorted(rows.mapInArrow(_write(folder, tokenizer_path, end_id), MANIFEST).collect())


def read_records(spark, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, record of every record, read from the files."""
    starts, at = [], 0
    for row in manifest:
        starts.append((row["path"], row["shard"], at))
        at += row["ids"]

    def rows(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, shard, start in zip(*(batch.column(c).to_pylist() for c in ("path", "shard", "start"))):
                out: list[tuple] = []
                for number, (doc_id, ids) in enumerate(read_file(store, path)):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, number))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _result(out)
                        out = []
                if out:
                    yield _result(out)

    names = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, record long"
    files = spark.createDataFrame(starts, "path string, shard long, start long")
    return files.repartition(max(1, len(starts)), "path").mapInArrow(rows, names) if starts else spark.createDataFrame([], names)


def _result(out: list[tuple]) -> pa.RecordBatch:
    columns = ("doc_id", "start", "n_tokens", "ids_crc32", "shard", "record")
    return pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(columns, zip(*out))})


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new folder of the session's shared folder and read the records back."""
    folder = new_folder(docs.sparkSession, "token-records")
    return read_records(docs.sparkSession, folder, write_records(docs, tokenizer_path, end_id, folder))
