"""SimHash near-dedup with pigeonring filtering.

A fingerprint is the majority, bit by bit, of the XXH64 hashes of a text's 3-word shingles, repeats included. Two texts link if their fingerprints differ in at most
`radius` bits. The bits are laid around a ring of `segments`; if two fingerprints are that near, there is a segment from which every chain of
consecutive segments stays within its share of the radius: the first l differ in at most floor(l radius / segments) bits, for each l. With 3 bits and 8
segments the budgets are 0, 0, 1, 1, 1, 2, 2, 3: two segments agree, and of the next three at most one bit differs, so two of these three agree as well. Each
fingerprint therefore goes to 8 x 3 keys of four agreeing segments, and only those that meet under a key are compared: chain by chain, each length
on what the shorter ones have left, the whole ring last, which is the full Hamming check.

Fingerprints are distinct before they are dealt, so that copies cost nothing. A key with many of them is cut into tiles of bounded size, every two slots of which meet in one
tile; a tile gives a spanning forest of its links, never its pairs. Nothing is left out: links are exact for any fingerprints.

Cases: null and texts without words have the fingerprint zero, and link like any other; a text of fewer than three words has one shingle, of all of them. Very long
texts are hashed whole, in pieces. Equal texts, ties and repeated rows share a fingerprint, hence a component; a null key is the least one only where
no row of a component has a key. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm._spark import materialise
from factgraph.llm.minhash import components

WIDTH, SEED, BITS = 3, 42, 64
_PIECE = 1 << 15


def _votes(text: bytes, width: int, seed: int) -> np.ndarray | None:
    """Bits set over all shingles, most significant first, as twice the count less the number of shingles; None without words."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, and words end at U+0020 and U+0009 to U+000D
    if not words:
        return None
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    to, at = (ends[width - 1 :], starts[: len(words) - width + 1]) if len(words) >= width else (ends[-1:], starts[:1])
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, len(at), _PIECE):
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(at[lo : lo + _PIECE].tolist(), to[lo : lo + _PIECE].tolist())], np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return 2 * total - len(at)


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint as a number of 64 bits."""
    votes = _votes((text or "").encode(), width, seed)
    return 0 if votes is None else int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, BITS), bool)
            for i, t in enumerate(batch.column(1)):
                votes = _votes(t.as_py() or b"", width, seed)
                if votes is not None:
                    found[i] = votes > 0
            prints = np.packbits(found, axis=1).reshape(-1, 8).view(">u8").ravel().astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Ring:
    """The bits in `segments` equal parts around a ring, for links of at most `radius` bits."""

    radius: int = 3
    segments: int = 8

    def __post_init__(self):
        if not 0 <= self.radius < self.segments or BITS % self.segments:
            raise ValueError("the radius is below the number of segments, which divides 64")

    @property
    def width(self) -> int:
        return BITS // self.segments

    def budget(self, length: int) -> int:
        return length * self.radius // self.segments

    @property
    def lead(self) -> int:
        """Segments from the start of a chain that agree."""
        return max(n for n in range(1, self.segments + 1) if self.budget(n) == 0)

    @property
    def next(self) -> int:
        """Segments after these that differ in at most one bit between them."""
        return max((n for n in range(1, self.segments + 1) if self.budget(n) == 1), default=self.lead) - self.lead

    def masks(self) -> list[int]:
        """Bits of a ring turned to its start which agree, for each segment that may hold the one bit."""
        ones, width = (1 << self.width) - 1, self.width
        part = [ones << (BITS - (i + 1) * width) for i in range(self.segments)]
        lead, more = sum(part[: self.lead]), part[self.lead : self.lead + self.next]
        return [lead | (sum(more) - m) for m in more] or [lead]

    def keys(self, fp: Column) -> Column:
        """array<struct<start, key>>: where this fingerprint may meet another within the radius."""
        found = []
        for start in range(self.segments):
            turn = start * self.width
            turned = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn)) if turn else fp
            for v, mask in enumerate(self.masks()):
                signed = mask - (1 << 64) if mask >> 63 else mask
                found.append(F.struct(F.lit(start).alias("start"), F.xxhash64(F.lit(start), F.lit(v), turned.bitwiseAND(F.lit(signed))).alias("key")))
        return F.array(*found)

    def viable(self, one: np.ndarray, other: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Indices of the pairs all of whose chains from `start` are within their budgets; the last chain is the whole ring."""
        differ, turn = one ^ other, (start * self.width).astype(np.uint64)
        differ = (differ << turn) | (differ >> ((np.uint64(BITS) - turn) % np.uint64(BITS)))
        left = np.arange(len(differ))
        for length in range(self.lead, self.segments + 1):
            chain = differ[left] >> np.uint64(BITS - length * self.width)
            left = left[np.bitwise_count(chain) <= self.budget(length)]
        return left


def _forest(fp: np.ndarray, start: int, ring: Ring) -> list[tuple[int, int]]:
    """Links that connect what is connected among distinct fingerprints. A search from one to all that are not yet reached, so
    that a group in which all are near costs a pass for each of its members over ever fewer of the rest."""
    rest, found = np.arange(len(fp)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            hits = ring.viable(np.full(len(rest), fp[one]), fp[rest], np.full(len(rest), start))
            found += [(int(one), int(r)) for r in rest[hits]]
            queue += rest[hits].tolist()
            rest = np.delete(rest, hits)
    return found


def _cell_links(cell: np.ndarray, start: np.ndarray, fp: np.ndarray, ring: Ring, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal cells. Small cells are compared together, by the distance of their members' places."""
    first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
    length = np.diff(np.r_[first, len(cell)])
    size, ends = np.repeat(length, length), np.repeat(first + length, length)
    a, b = [], []
    for off in range(1, int(min(length.max(), small))):
        i = np.flatnonzero((size <= small) & (np.arange(len(fp)) + off < ends))
        hits = i[ring.viable(fp[i], fp[i + off], start[i])]
        a.append(fp[hits])
        b.append(fp[hits + off])
    for at, n in zip(first[length > small], length[length > small]):
        part = fp[at : at + n]
        found = np.array(_forest(part, int(start[at]), ring), np.int64).reshape(-1, 2)
        a.append(part[found[:, 0]])
        b.append(part[found[:, 1]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(nodes: DataFrame, ring: Ring = Ring(), tile: int = 4096) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` which connect all that are at most ring.radius bits apart, directly or through others."""
    keyed = materialise(nodes.select("fp", F.explode(ring.keys(F.col("fp"))).alias("k")).select("k.start", "k.key", "fp"), "keys")
    many = keyed.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("slots"), F.count("*").alias("n")).where("n > 1").select("key", "slots")
    met = keyed.join(many, "key")
    slot = F.pmod(F.xxhash64("fp", F.lit(7)), "slots")
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1), lambda j: (j != slot) | (F.col("slots") == 1))
    dealt = met.select("start", "key", "fp", slot.alias("slot"), F.explode(others).alias("other"))
    dealt = dealt.select("key", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "start", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells follow each other; one may go on in the next batch."""
        held = np.zeros((0, 5), np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)])
            if not len(held):
                continue
            same = (held[:, :3] == held[-1, :3]).all(1)
            to = len(held) if batch is None else int(len(held) - np.argmin(same[::-1])) if not same.all() else 0
            if not to:
                continue
            now, held = held[:to], held[to:]
            a, b = _cell_links(now[:, :3], now[:, 3], now[:, 4].view(np.uint64) if now[:, 4].flags.c_contiguous else np.ascontiguousarray(now[:, 4]).view(np.uint64), ring)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", ring: Ring = Ring()) -> DataFrame:
    """(key, fingerprint, component_id) of every row: rows whose fingerprints link, directly or through others, have the least key among them."""
    prints = materialise(fingerprints(docs, key, text), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("key").alias("least")), "nodes")
    found = components(materialise(links(nodes, ring), "links"))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    named = materialise(named, "components")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "comp").select("fp", "component_id")
    return prints.join(of_node, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", ring: Ring = Ring()) -> DataFrame:
    """The rows whose key is that of their component: one text of each group of near copies (rows that repeat a key stay together)."""
    ids = near_components(docs, key, text, ring).select(F.col("component_id").alias("_kept")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(F.col("_kept")), "left_semi")
