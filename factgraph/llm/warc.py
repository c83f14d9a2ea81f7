"""WARC archives of pages, and their capture index by external merge.

Write: each task writes one gzipped archive (a member per record) into the shared folder and returns its name; a name belongs to one
attempt, so that a task run again leaves only an unused file. Of records with equal payloads the one with the smallest page_id is
stored; the others are revisit records that refer to it. Index: each task reads archives back, checks payload digests, and returns its captures
sorted by URL key and timestamp: a run. Merge: runs are dealt by ranges of (key, timestamp, record) and each range is merged from its runs by a loser
tree, which gives globally ordered capture histories.

Cases: null html is an empty payload; rows that repeat a page_id and payload are one response and revisits to it; null page_id counts as larger than
any other; a null url is written without target. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm._spark import materialise, new_path

EPOCH = datetime.datetime(2024, 1, 1)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = hashlib.sha1(b"").hexdigest()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def timestamp(page_id: int | None) -> str:
    """The tables have no capture time: one second a page_id, counted from a fixed day."""
    return (EPOCH + datetime.timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the path and query in lower case: sorts the captures of a site together."""
    try:
        parts = urlsplit((url or "").strip())
        name, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return ")" + re.sub(r"\s", "%20", (url or "").lower())
    name = re.sub(r"^www\d*\.", "", name)
    tail = (parts.path or "/") + ("?" + "&".join(sorted(parts.query.split("&"))) if parts.query else "")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + re.sub(r"\s", "%20", tail.lower())


def opened(uri: str, mode: str):
    """A binary file in the shared folder; anything but file: goes through Arrow's file systems."""
    if uri.startswith("file:") or "://" not in uri:
        path = re.sub(r"^file:(//)?", "", uri)
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        system.create_dir(os.path.dirname(path), recursive=True)
        return system.open_output_stream(path)
    return io.BufferedReader(pa.PythonFile(system.open_input_stream(path)))


def record(kind: str, ident: str, date: str, url: str | None, payload: bytes, full_digest: str, n_bytes: int, refers_to: str | None = None) -> bytes:
    """One record, not compressed. A revisit has no payload but names its digest and size."""
    clean = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    body = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"]
    head += [f"WARC-Target-URI: {clean}"] if clean is not None else []
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if kind == "revisit" else []
    head += [f"WARC-Payload-Digest: sha1:{full_digest}", f"WARC-Payload-Length: {n_bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def members(stream, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream; holds one record at a time."""
    at, data = 0, b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        unzip, out, size = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    raise EOFError("an archive ends within a record")
            out.append(unzip.decompress(data))
            size += len(data) - len(unzip.unused_data)
            data = unzip.unused_data
        yield at, size, b"".join(out)
        at += size


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record; raises if a response's payload has another digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(named["content-length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    if named["warc-type"] == "response" and f"sha1:{digest(payload)}" != named["warc-payload-digest"]:
        raise ValueError(f"payload of {named['warc-record-id']} is damaged")
    return named, payload


def write(pages: DataFrame, folder: str, least_bytes: int = 0, level: int = 2) -> DataFrame:
    """Archives in `folder`; returns (file, n) of those that count. pages: page_id, url, html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    ids = rows.select("sha", F.coalesce("page_id", F.lit(2**63 - 1)).alias("id"), F.octet_length("html").alias("size"))
    shared = ids.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("sha2"), "first")
    known = ids.select("sha", "id").join(shared, F.col("sha") == F.col("sha2")).groupBy(F.col("id").alias("id2"), F.col("sha").alias("sha3")).agg(F.min("first").alias("first"))
    # dealt out once: the join keeps this partitioning, in which copies of a row lie together, so that the first of them can be told
    dealt = rows.withColumn("id", F.coalesce("page_id", F.lit(2**63 - 1))).repartition("id", "sha")
    joined = dealt.join(known, (F.col("id") == F.col("id2")) & (F.col("sha") == F.col("sha3")), "left").select("id", "url", "html", "first", "sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, n, before, times = None, 0, None, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                for ident, url, text, first, sha in zip(*[c.to_pylist() for c in whole.slice(at, 500).columns]):
                    out = out or opened(name, "wb")
                    payload = text.encode()
                    times = times + 1 if before == (ident, sha) else 0
                    before = (ident, sha)
                    again = first is not None and (first != ident or times > 0)
                    page = None if ident == 2**63 - 1 else ident
                    own = f"urn:page:{'null' if page is None else page}:{times}"
                    raw = record("revisit" if again else "response", own, timestamp(page), url, b"" if again else payload, base64.b32encode(sha).decode(), len(payload), f"urn:page:{'null' if first == 2**63 - 1 else first}:0" if again else None)
                    zipped = zlib.compressobj(level, wbits=31)
                    out.write(zipped.compress(raw) + zipped.flush())
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])

    return materialise(joined.sortWithinPartitions("id", "sha", "url").mapInArrow(run, "file string, n long"), "archives")


CAPTURE = "url_key string, timestamp string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def _page_of(ident: str | None) -> int | None:
    m = re.search(r"urn:page:(-?\d+):", ident or "")
    return int(m[1]) if m else None


def index_runs(archives: DataFrame) -> DataFrame:
    """The captures of the archives named in `file`, with the number of their run; each run is sorted by URL key and timestamp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                rows = []
                with opened(name, "rb") as stream:
                    for at, size, raw in members(stream):
                        h, payload = read_record(raw)
                        date, url, kind = re.sub(r"\D", "", h["warc-date"]), h.get("warc-target-uri"), h["warc-type"]
                        n = len(payload) if kind == "response" else int(h["warc-payload-length"])
                        rows.append((url_key(url), date, h["warc-record-id"], _page_of(h["warc-record-id"]), url, n, h["warc-payload-digest"].removeprefix("sha1:"), kind, _page_of(h.get("warc-refers-to")), name, at, size))
                rows.sort(key=lambda r: r[:3])
                frame = pd.DataFrame(rows, columns=[x.split()[0] for x in CAPTURE.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
                frame["run"] = name
                yield frame

    n = max(1, archives.count())
    return archives.select("file").repartition(n, F.xxhash64("file")).mapInPandas(run, f"{CAPTURE}, run string")


class LoserTree:
    """k-way merge of sorted iterators: each output costs one comparison a level."""

    def __init__(self, runs: Iterable[Iterator], key: Callable):
        self._runs, self._key = [iter(r) for r in runs], key
        self._k = len(self._runs)
        self._heads = [next(r, None) for r in self._runs]
        self._tree = [-1] * max(1, self._k)
        for i in range(self._k - 1, -1, -1):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether leaf a comes before leaf b; -1 comes before all, an ended run after all."""
        if a < 0 or b < 0:
            return a < 0 <= b
        x, y = self._heads[a], self._heads[b]
        if x is None or y is None:
            return x is not None
        return (self._key(x), a) < (self._key(y), b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self._k) // 2
        while node > 0:
            if self._less(self._tree[node], winner):
                winner, self._tree[node] = self._tree[node], winner
            node //= 2
        self._tree[0] = winner

    def __iter__(self) -> Iterator:
        while self._k and (x := self._heads[self._tree[0]]) is not None:
            at = self._tree[0]
            yield x
            self._heads[at] = next(self._runs[at], None)
            self._play(at)


def merge(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """All captures in the order of (url_key, timestamp, record_id) over the partitions; a range holds about rows_per_range rows."""
    names = [f.name for f in runs.schema.fields if f.name != "run"]
    key = [names.index(c) for c in ("url_key", "timestamp", "record_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            at = schema.get_field_index("run")
            columns = [c.to_pylist() for i, c in enumerate(batch.columns) if i != at]
            for name, row in zip(batch.column(at).to_pylist(), zip(*columns)):
                held.setdefault(name, []).append(row)
        for rows in held.values():  # blocks of a run may have arrived in any order; a sorted list is left as it is
            rows.sort(key=lambda r: tuple(r[i] for i in key))
        out: list[tuple] = []
        if schema is None:
            return
        kept = [schema.field(n) for n in names]
        for row in LoserTree([iter(r) for r in held.values()], lambda r: tuple(r[i] for i in key)):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kept)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kept)], names=names)

    n = max(1, -(-runs.count() // rows_per_range))
    return runs.repartitionByRange(n, "url_key", "timestamp", "record_id").mapInArrow(run, CAPTURE)


def captures(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back, and return the merged index of their captures."""
    spark: SparkSession = pages.sparkSession
    archives = write(pages, folder or new_path(spark, "warc"))
    return merge(materialise(index_runs(archives), "runs"))


def payload_at(file: str, offset: int, length: int) -> bytes:
    """The payload of one capture, by its place in the index."""
    with opened(file, "rb") as f:
        f.seek(offset)
        return read_record(gzip.decompress(f.read(length)))[1]
