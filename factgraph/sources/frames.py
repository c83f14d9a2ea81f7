"""Framed, append-only fact logs: writing frames, reading their valid prefix, checking them.

A frame is magic (u16), flags (u8), core length, meta length and CRC-32C (u32 each, little-endian), the fact's 32-byte id, then the canonical
fact and its metadata. The CRC covers all other bytes. A log counts up to its first frame that is short, foreign or damaged.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = 0xB6AD
HEADER = "<HBIII"
FIXED = 47
RAW, ZSTD, ZSTD_DICTIONARY = 0, 1, 2
POLYNOMIAL = 0x82F63B78

_BLOCK = 4096
#: Frames that a task holds before it hands them on, and rows that it takes from what Spark hands it at a time.
BATCH = 5_000
ROWS = 1_000
#: Bytes of logs that are checked together.
GROUP = 4_000_000
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
FRAME_SCHEMA = "path string, offset long, length long, fact_id string, codec int, core string, patient_root string, written_at string, verified boolean"
REPORT_SCHEMA = "path string, frames long, valid_upto long, damaged boolean, reason string, failed_hashes long"


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of one byte, and of _BLOCK zero bytes applied to each byte of a state."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    far = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(_BLOCK):
        far = one[far & 0xFF] ^ (far >> np.uint32(8))
    return one, far.reshape(4, 256)


def crc32c(data: np.ndarray, starts: list[int], ends: list[int], gap: tuple[int, int] = (0, 0)) -> list[int]:
    """CRC-32C of data[start:end] for each pair, without the bytes of `gap` (relative to the start).

    All ranges advance together, a byte a step: long ones as blocks whose CRCs are joined afterwards, so that one long range costs no more steps."""
    one, far = _tables()
    cut, hole = gap[0], gap[1] - gap[0]
    at, size, first = [], [], []
    for s, e in zip(starts, ends):
        n = e - s - hole
        head = n % _BLOCK or min(n, _BLOCK)
        first.append(len(at))
        at += [(s, 0)] + [(s, k) for k in range(head, n, _BLOCK)]
        size += [head] + [_BLOCK] * ((n - head) // _BLOCK)
    if not at:
        return []
    base, begin, length = np.array([a for a, _ in at]), np.array([b for _, b in at]), np.array(size)
    order = np.argsort(-length, kind="stable")
    base, begin, length = base[order], begin[order], length[order]
    state = np.where(begin == 0, np.uint32(0xFFFFFFFF), np.uint32(0)).astype(np.uint32)
    alive = len(length)
    for i in range(int(length[0]) if len(length) else 0):
        while alive and length[alive - 1] <= i:
            alive -= 1
        p = begin[:alive] + i
        byte = data[base[:alive] + np.where(p < cut, p, p + hole)] if hole else data[base[:alive] + p]
        state[:alive] = one[(state[:alive] ^ byte) & 0xFF] ^ (state[:alive] >> np.uint32(8))
    back = np.empty_like(state)
    back[order] = state
    out = []
    for k, f in enumerate(first):
        c = int(back[f])
        for b in range(f + 1, first[k + 1] if k + 1 < len(first) else len(at)):
            c = int(far[0][c & 0xFF] ^ far[1][c >> 8 & 0xFF] ^ far[2][c >> 16 & 0xFF] ^ far[3][c >> 24]) ^ int(back[b])
        out.append(c ^ 0xFFFFFFFF)
    return out


def encode(facts: list[tuple[str, str, str | None, str]], codec: int = ZSTD) -> list[bytes]:
    """Frames of (fact_id, canonical text, patient_root, written_at)."""
    if codec not in (RAW, ZSTD):
        raise ValueError("frames are written raw or with zstd")
    pack = zstandard.ZstdCompressor().compress if codec == ZSTD else bytes
    frames = []
    for fact_id, core, root, at in facts:
        body, meta = pack(core.encode()), json.dumps({"patient_root": root or "", "written_at": at}, separators=(",", ":")).encode()
        frames.append(bytearray(struct.pack(HEADER, MAGIC, codec, len(body), len(meta), 0) + bytes.fromhex(fact_id) + body + meta))
    ends = np.cumsum([0, *map(len, frames)])
    data = np.frombuffer(b"".join(frames), dtype=np.uint8)
    for frame, c in zip(frames, crc32c(data, list(ends[:-1]), list(ends[1:]), (11, 15))):
        struct.pack_into("<I", frame, 11, c)
    return [bytes(f) for f in frames]


def _heads(content: bytes) -> tuple[list[tuple[int, int, int, int, int]], str]:
    """(start, end, codec, core length, CRC) of each frame by the headers alone, and why they end before the end or ''."""
    heads, at = [], 0
    while at < len(content):
        if len(content) - at < FIXED:
            return heads, "short frame"
        magic, flags, n_core, n_meta, crc = struct.unpack_from(HEADER, content, at)
        end = at + FIXED + n_core + n_meta
        if magic != MAGIC or flags & 0xF0 or flags & 0x0F > ZSTD_DICTIONARY:
            return heads, "bad header"
        if end > len(content):
            return heads, "short frame"
        heads.append((at, end, flags & 0x0F, n_core, crc))
        at = end
    return heads, ""


def _records(content: bytes, heads: list[tuple[int, int, int, int, int]], sums: list[int], reason: str) -> tuple[list[dict], int, str]:
    records, valid = [], 0
    for (s, e, codec, n_core, want), got in zip(heads, sums):
        body, raw = content[s + FIXED : s + FIXED + n_core], content[s + FIXED + n_core : e]
        try:
            meta = json.loads(raw) if raw else {}
        except ValueError:
            meta = None
        if got != want or not isinstance(meta, dict):
            return records, valid, "checksum" if got != want else "metadata"
        records.append({"offset": s, "length": e - s, "fact_id": content[s + 15 : s + FIXED].hex(), "codec": codec, "body": body, "meta": meta})
        valid = e
    return records, valid, reason


def scan_all(contents: list[bytes]) -> Iterator[tuple[list[dict], int, str]]:
    """Of each log: (records, bytes of the valid prefix, why it ended before the end or ''). The CRCs of all their frames advance together."""
    found = [_heads(c) for c in contents]
    begins = np.cumsum([0, *map(len, contents)]).tolist()
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    starts, ends = ([b + h[k] for b, (heads, _) in zip(begins, found) for h in heads] for k in (0, 1))
    sums, at = crc32c(data, starts, ends, (11, 15)), 0
    for content, (heads, reason) in zip(contents, found):
        yield _records(content, heads, sums[at : at + len(heads)], reason)
        at += len(heads)


def scan(content: bytes) -> tuple[list[dict], int, str]:
    """(records, bytes of the valid prefix, why it ended before the end or '')."""
    return next(scan_all([content]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of at most ROWS rows at a time, so that what a worker holds doesn't follow from how many rows come together."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield [c.to_pylist() for c in batch.slice(at, ROWS).columns]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


def _scanned(logs: Iterator[tuple[str, bytes | None]]) -> Iterator[tuple[str, tuple[list[dict], int, str]]]:
    """(path, what scan finds) of logs, read in groups of at most GROUP bytes or one log."""
    paths, contents, size = [], [], 0
    for path, content in logs:
        content = content or b""
        if contents and size + len(content) > GROUP:
            yield from zip(paths, scan_all(contents))
            paths, contents, size = [], [], 0
        paths.append(path)
        contents.append(content)
        size += len(content)
    yield from zip(paths, scan_all(contents))


def core_text(record: dict) -> str | None:
    """The canonical fact of a record, None if it can't be decoded."""
    try:
        if record["codec"] == ZSTD_DICTIONARY:
            return None  # no dictionary is known
        return (record["body"] if record["codec"] == RAW else zstandard.ZstdDecompressor().decompressobj().decompress(record["body"])).decode()
    except (zstandard.ZstdError, UnicodeDecodeError):
        return None


def read_logs(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of the logs below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")


def frames(logs: DataFrame) -> DataFrame:
    """A row per valid frame of logs (path, content); `verified`: its text has the hash that its id states. One log is one task's work, as each frame's place depends on those before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows: list[tuple] = []
            for path, (records, _, _) in _scanned(zip(*part)):
                for r in records:
                    core = core_text(r)
                    rows.append((path, r["offset"], r["length"], r["fact_id"], r["codec"], core, r["meta"].get("patient_root") or None, r["meta"].get("written_at"), core is not None and hashlib.sha256(core.encode()).hexdigest() == r["fact_id"]))
                if len(rows) >= BATCH:
                    yield _batch(rows, FRAME_SCHEMA)
                    rows = []
            if rows:
                yield _batch(rows, FRAME_SCHEMA)

    return logs.select("path", "content").mapInArrow(run, FRAME_SCHEMA)


def verify(logs: DataFrame) -> DataFrame:
    """A row per log: frames, bytes of the valid prefix, damage and its reason, and frames whose hash is not their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rows = []
            for path, (records, valid, reason) in _scanned(zip(*part)):
                wrong = sum((t := core_text(r)) is None or hashlib.sha256(t.encode()).hexdigest() != r["fact_id"] for r in records)
                rows.append((path, len(records), valid, bool(reason), reason, wrong))
            yield _batch(rows, REPORT_SCHEMA)

    return logs.select("path", "content").mapInArrow(run, REPORT_SCHEMA)


def append_frames(facts: DataFrame, segment: int = 10_000, codec: int = ZSTD) -> DataFrame:
    """(path, content): logs of facts (fact_id, core, patient_root, written_at, append_seq), a log for `segment` positions of a patient, so that
    a patient with very many facts has many logs; facts without a patient go to logs named _shared. Facts are moved once, and a log is joined as its frames go by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts = None, []

        def out(done: list[tuple[str, list[bytes]]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([b"".join(p) for _, p in done], pa.binary())], names=["path", "content"])

        for path, *rows in _parts(batches):
            done = []
            for p, frame in zip(path, encode(list(zip(*rows[:4])), codec)):
                if p != name:
                    if parts:
                        done.append((name, parts))
                    name, parts = p, []
                parts.append(frame)
            if done:
                yield out(done)
        if parts:
            yield out([(name, parts)])

    named = F.concat(F.coalesce("patient_root", F.lit("_shared")), F.lit("/"), F.lpad(F.floor(F.col("append_seq") / segment).cast("string"), 9, "0"))
    rows = facts.select(named.alias("path"), "fact_id", "core", F.coalesce("patient_root", F.lit("")).alias("patient_root"), "written_at", "append_seq")
    return rows.repartition("path").sortWithinPartitions("path", "append_seq", "fact_id").mapInArrow(run, "path string, content binary")
