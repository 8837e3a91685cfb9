"""WARC archives and the external merge of their capture indexes.

Writing: each partition writes one archive of gzip members (a record each, so that
any can be read alone).  Of records with equal payloads of at least ``least`` bytes, the
one with the smallest page_id is a ``response`` with the payload; the others are
``revisit`` records that name it.  Digests are grouped with map-side aggregation
and joined back to the rows, so a payload of a third of all pages is not one list.

Reading: one pass over each archive rebuilds every record from its bytes (digest and length
of a response come from its payload) and leaves a run: the archive's captures sorted
by (url key, timestamp, page_id), in blocks, with a directory of the blocks' first keys.

Merging: the blocks' first keys, a fixed number of each run at most, give splitters on whole sort tuples (so
one url key may span ranges).  Each range is a task that opens every run at its
own block and merges them with a loser tree: one comparison per level and capture, and one block per run in
memory.  The ranges in order are the globally ordered capture histories.  More than
``FAN_IN`` runs are first merged in groups, also range by range, so no task ever reads more than one range of ``FAN_IN`` runs.

Files go to the shared folder under a temporary name and are renamed when whole.

Cases: null html is an empty payload; null url has the empty key; null page_ids come last
(never a reason for a revisit of another; rows with the smallest page_id of
their payload are all responses); an empty table gives no archive and no rows; further columns are
not looked at.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameloom.llm.common import new_folder
from nameloom.llm.token_records import open_store

BLOCK, FAN_IN, SAMPLES = 512, 256, 512
#: Rows that are Python objects at a time in a worker.
SLICE = 50
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
FILES = "shard long, path string, records long"
CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, captured string, archive string, offset long, length long, range long, place long"
NO_ID = 1 << 63


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then path and query: captures of a host sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return (url or "").lower()
    host = host[4:] if host.startswith("www.") else host
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{labels}){(parts.path or '/').lower()}{'?' + parts.query.lower() if parts.query else ''}" if host else (url or "").lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A UUID made from the page_id, so that it can be named before it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_uri(url: str | None) -> str | None:
    """``url`` as a bare header value: white space, control characters and all beyond ASCII are percent-encoded."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~<>\"\\^`{|}") or None if url else None


def warc_record(page_id, url, captured: str, kind: str, payload: bytes | None, digest: str, size: int, refers_to) -> bytes:
    """One record as a gzip member with fixed header bytes, so that a second attempt writes the same."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", captured)]
    target = header_uri(url)
    if target:
        fields.append(("WARC-Target-URI", target))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", json.dumps(page_id))]
    if target != url:  # null, empty, or with characters that a header cannot hold
        fields.append(("X-Page-Url", json.dumps(url, ensure_ascii=True)))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", json.dumps(refers_to)), ("X-Payload-Length", str(size))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload or b"")
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of an uncompressed record; payload length and digest of a response are taken from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    url = json.loads(fields["X-Page-Url"]) if "X-Page-Url" in fields else fields.get("WARC-Target-URI")
    out = {"page_id": json.loads(fields["X-Page-Id"]), "url": url, "captured": fields["WARC-Date"], "record_type": fields["WARC-Type"], "refers_to": None}
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["record_type"] == "revisit":
        return out | {"refers_to": json.loads(fields["X-Refers-To-Page"]), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": stated, "payload": None}
    if digest32(payload) != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": stated, "payload": payload}


def read_archive(store, path: str, chunk: int = 1 << 20):
    """(offset, length, uncompressed bytes) of each gzip member of an archive, streamed."""
    with store.open_input_stream(path, compression=None) as f:
        press, parts, at, start = zlib.decompressobj(31), [], 0, 0
        while data := f.read(chunk):
            while data:
                parts.append(press.decompress(data))
                if not press.eof:
                    at += len(data)
                    break
                at += len(data) - len(press.unused_data)
                yield start, at - start, b"".join(parts)
                data, press, parts, start = press.unused_data, zlib.decompressobj(31), [], at
        if start != at:
            raise ValueError(f"{path}: the last record is cut off")


def sort_key(capture: dict) -> tuple:
    page = capture["page_id"]
    return capture["url_key"], capture["captured"], NO_ID if page is None else page, capture["archive"], capture["offset"]


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.n = len(self.runs)
        self.heads = [self._next(i) for i in range(self.n)]
        self.losers = [-1] * self.n
        self.winner = self._play(1) if self.n else -1

    def _next(self, i: int):
        for item in self.runs[i]:
            return self.key(item), item
        return None

    def _before(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or (a[0], i) <= (b[0], j))

    def _play(self, node: int) -> int:
        """First matches below ``node``; leaves are the nodes n to 2n - 1."""
        if node >= self.n:
            return node - self.n
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._before(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.n and self.heads[self.winner] is not None:
            won = self.winner
            yield self.heads[won][1]
            self.heads[won] = self._next(won)
            node = (won + self.n) // 2
            while node >= 1:
                if self._before(self.losers[node], won):
                    won, self.losers[node] = self.losers[node], won
                node //= 2
            self.winner = won


def write_run(store, path: str, captures, attempt: int) -> int:
    """Write sorted captures as gzip blocks of JSON lines, and a directory of (first key, offset, length)."""
    directory, at, count = [], 0, 0
    with store.open_output_stream(f"{path}.run.{attempt}") as f:
        block: list[dict] = []

        def flush():
            nonlocal at
            raw = gzip.compress("\n".join(map(json.dumps, block)).encode(), 1, mtime=0)
            directory.append([sort_key(block[0]), at, len(raw)])
            f.write(raw)
            at += len(raw)
            block.clear()

        for capture in captures:
            block.append(capture)
            count += 1
            if len(block) == BLOCK:
                flush()
        if block:
            flush()
    with store.open_output_stream(f"{path}.dir.{attempt}") as f:
        f.write(json.dumps(directory).encode())
    store.move(f"{path}.dir.{attempt}", f"{path}.dir")
    store.move(f"{path}.run.{attempt}", f"{path}.run")
    return count


def read_directory(store, path: str) -> list:
    with store.open_input_stream(f"{path}.dir") as f:
        return [(tuple(k), at, n) for k, at, n in json.loads(f.read())]


def read_run(store, path: str, low: tuple | None = None, high: tuple | None = None):
    """Captures of a run with low <= key < high, block by block from where ``low`` may be."""
    blocks = read_directory(store, path)
    first = max(0, bisect.bisect_right([b[0] for b in blocks], low) - 1) if low is not None else 0
    with store.open_input_file(f"{path}.run") as f:
        for key, at, size in blocks[first:]:
            if high is not None and key >= high:
                return
            f.seek(at)
            for line in gzip.decompress(f.read(size)).split(b"\n"):
                capture = json.loads(line)
                own = sort_key(capture)
                if (low is None or own >= low) and (high is None or own < high):
                    yield capture


def planned(pages: DataFrame, least: int, captured) -> DataFrame:
    """page_id, url, payload, captured, first: the smallest page_id with the same payload (null if none or too small)."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"), captured.alias("captured"))
    rows = rows.withColumn("_digest", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(firsts, "_digest", "left").drop("_digest")


def _write(folder: str):
    def rows(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = open_store(folder)
        path, offset, count, out = f"{root}/archive-{task.partitionId():06d}.warc.gz", 0, 0, None
        for batch in batches:
            for row in (r for i in range(0, len(batch), SLICE) for r in batch.slice(i, SLICE).to_pylist()):
                page, payload, first = row["page_id"], row["payload"], row["first"]
                again = first is not None and page != first
                raw = warc_record(page, row["url"], row["captured"], "revisit" if again else "response", None if again else payload, digest32(payload), len(payload), first if again else None)
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{path}.{task.taskAttemptId()}", compression=None)
                out.write(raw)
                count += 1
        if out is not None:
            out.close()
            store.move(f"{path}.{task.taskAttemptId()}", path)
            yield pa.record_batch({"shard": pa.array([task.partitionId()], pa.int64()), "path": [path], "records": pa.array([count], pa.int64())})

    return rows


def _index(folder: str, run_size: int):
    """Read archives back; leave sorted runs of at most ``run_size`` captures."""

    def rows(batches):
        from pyspark import TaskContext

        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                captures, number, out = [], 0, []

                def leave(captures, number):
                    captures.sort(key=sort_key)
                    run = f"{path}.{number:04d}"
                    return run, write_run(store, run, captures, TaskContext.get().taskAttemptId())

                for offset, length, raw in read_archive(store, path):
                    capture = parse_record(raw)
                    del capture["payload"]
                    captures.append(capture | {"url_key": url_key(capture["url"]), "archive": path.rpartition("/")[2], "offset": offset, "length": length})
                    if len(captures) == run_size:
                        out.append(leave(captures, number))
                        captures, number = [], number + 1
                if captures:
                    out.append(leave(captures, number))
                yield pa.record_batch({"shard": pa.array(range(len(out)), pa.int64()), "path": [r for r, _ in out], "records": pa.array([n for _, n in out], pa.int64())})

    return rows


def _combine(folder: str, ranges: list[list[str]], edges: list, prefix: str, fan_in: int):
    """Merge ``fan_in`` runs of one key range to one run of that range."""

    def rows(batches):
        from pyspark import TaskContext

        store, _ = open_store(folder)
        for batch in batches:
            for number, group in zip(*(batch.column(c).to_pylist() for c in ("range", "group"))):
                paths, target = ranges[number][group * fan_in : (group + 1) * fan_in], f"{prefix}-{number:06d}-{group:05d}"
                count = write_run(store, target, LoserTree([read_run(store, p, edges[number], edges[number + 1]) for p in paths], sort_key), TaskContext.get().taskAttemptId())
                yield pa.record_batch({"shard": pa.array([number], pa.int64()), "path": [target], "records": pa.array([count], pa.int64())})

    return rows


def _sample(folder: str):
    """Up to SAMPLES evenly spaced first keys of each run's blocks, as JSON."""

    def rows(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                keys = [k for k, _, _ in read_directory(store, path)]
                step = max(1, len(keys) // SAMPLES)
                yield pa.record_batch({"keys": [json.dumps(keys[::step])]})

    return rows


def _merge(folder: str, ranges: list[list[str]], edges: list):
    def rows(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for number in batch.column("range").to_pylist():
                out, place = [], 0
                for capture in LoserTree([read_run(store, p, edges[number], edges[number + 1]) for p in ranges[number]], sort_key):
                    out.append(capture | {"range": number, "place": place})
                    place += 1
                    if len(out) == 5_000:
                        yield _captures(out)
                        out = []
                if out:
                    yield _captures(out)

    return rows


def _captures(out: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.record_batch({name: pa.array([c[name] for c in out], kinds[kind]) for name, kind in (x.split(" ") for x in CAPTURES.split(", "))})


def merge_runs(spark, folder: str, paths: list[str], ranges: int, fan_in: int = FAN_IN) -> DataFrame:
    """All captures of the runs: globally ordered by (range, place).  No task merges more than ``fan_in`` runs or one key range."""
    runs = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 64)), "path")
    keys = sorted(tuple(k) for row in runs.mapInArrow(_sample(folder), "keys string").collect() for k in json.loads(row["keys"]))
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)} - {keys[0]}) if keys else []
    edges = [None, *cuts, None]
    by_range = [paths] * (len(edges) - 1)
    turn = 0
    while max(map(len, by_range)) > fan_in:
        tasks = [(i, g) for i, p in enumerate(by_range) for g in range(-(-len(p) // fan_in))]
        table = spark.createDataFrame(tasks, "range long, group long").repartition(len(tasks), "range", "group")
        merged = table.mapInArrow(_combine(folder, by_range, edges, f"{paths[0].rpartition('/')[0]}/merged-{turn}", fan_in), FILES).collect()  # one row per range and group
        by_range, turn = [sorted(r["path"] for r in merged if r["shard"] == i and r["records"]) for i in range(len(by_range))], turn + 1
    tasks = spark.createDataFrame([(i,) for i in range(len(by_range))], "range long").repartition(len(by_range), "range")
    return tasks.mapInArrow(_merge(folder, by_range, edges), CAPTURES)


def capture_history(pages: DataFrame, least: int = 0, captured=None, folder: str | None = None, ranges: int | None = None, run_size: int = 50_000, fan_in: int = FAN_IN) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC archives, read them back, and merge their indexes.

    ``captured``: an ISO timestamp column; page_id seconds after a fixed day if none.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    if captured is None:
        captured = F.date_format(F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.coalesce(F.col("page_id"), F.lit(0)) % 10**9), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    archives = sorted(planned(pages, least, captured).mapInArrow(_write(folder), FILES).collect())
    if not archives:
        return spark.createDataFrame([], CAPTURES)
    table = spark.createDataFrame([(a["path"],) for a in archives], "path string").repartition(len(archives), "path")
    runs = sorted(r["path"] for r in table.mapInArrow(_index(folder, run_size), FILES).collect())
    return merge_runs(spark, folder, runs, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
