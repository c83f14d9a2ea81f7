"""Best-fit packing of tokenised documents into sequences: a configuration linear program over the length histogram.

Documents become token ids plus an end id; only those longer than a sequence are cut, the first piece taking the
remainder. The driver sees the histogram of piece lengths, which has `capacity` cells at any corpus size. Multiplicative weights solve the covering
program: a dual price per length, a knapsack dynamic program that finds the best configurations at these prices, prices falling for
the lengths that they cover; any prices bound the number of sequences from below. The fractional plan is rounded down, the program solved again for what is left,
and the last residue packed best-fit decreasing (README has its share). Each piece then finds its place by its rank among the pieces of its length, in a table that grows with the configurations, not the rows.

Cases: null counts as the empty text, which is the end id alone; repeated rows are packed each on its own; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm._spark import materialise


@dataclass(frozen=True)
class Packing:
    """vocabulary and ranks: the same vocabulary as files for two libraries; "" stands for the installed ones."""

    capacity: int = 1024
    end: int = 2
    vocabulary: str = ""
    ranks: str = ""


#: Texts of these characters alone are tokenised from the rank file, several times as fast; tests hold that both libraries give the same ids.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-‧]*")


@lru_cache(maxsize=2)
def _slow(vocabulary: str):
    from tokenizers import Tokenizer

    if not vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(vocabulary)


@lru_cache(maxsize=2)
def _fast(ranks: str):
    import public_tokenizers
    import tiktoken

    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, how: Packing = Packing()) -> np.ndarray:
    """Ids as the tokenizer file gives them, without added special tokens, and the end id."""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        ids = _fast(how.ranks).encode_ordinary(text)
    else:
        ids = _slow(how.vocabulary).encode(text, add_special_tokens=False).ids
    return np.array([*ids, how.end], dtype="<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, how: Packing = Packing(), with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per piece: key, piece, start, length, ids_crc32, (ids,) part and rank, its number among the pieces of this length in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        counts = np.zeros(how.capacity + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows, row, ids_out = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    ids = encode(t or "", how)
                    for k, (start, length) in enumerate(cuts(len(ids), how.capacity)):
                        own = ids[start : start + length]
                        rows.append((k, start, length, zlib.crc32(own.tobytes()), part, counts[length]))
                        counts[length] += 1
                        row.append(i)
                        if with_ids:
                            ids_out.append(own.astype(np.int32))
                if not rows:
                    continue
                cols = [np.array(c, np.int64) for c in zip(*rows)]
                arrays = [batch.column(0).take(pa.array(row)), pa.array(cols[0].astype(np.int32)), *map(pa.array, cols[1:4]), pa.array(cols[4].astype(np.int32)), pa.array(cols[5])]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    names = ["key", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
    fields = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<int>" * with_ids).fields
    return docs.select(F.col(key).alias("key"), text).mapInArrow(run, T.StructType([T.StructField("key", docs.schema[key].dataType), *fields]))


def price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack by dynamic programming: the best value by room, and the index of a length placed there first (of equals the longest; -1: none more
    than in a smaller room)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = (value[:k] + best[c - lengths[:k]])[::-1]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], pick[c] = got[j], k - 1 - j
    return best, pick


def configurations(lengths: np.ndarray, pick: np.ndarray, first: np.ndarray, capacity: int) -> np.ndarray:
    """A row of counts by length for each index in `first`: the best configuration that holds a piece of that length."""
    out = np.zeros((len(first), len(lengths)), np.int64)
    live = np.arange(len(first))
    out[live, first] += 1
    room = capacity - lengths[first]
    last = np.maximum.accumulate(np.where(pick >= 0, np.arange(capacity + 1), 0))
    while len(live):
        room[live] = last[room[live]]
        live = live[room[live] > 0]
        j = pick[room[live]]
        out[live, j] += 1
        room[live] -= lengths[j]
    return out


def best_fit(histogram: np.ndarray) -> list[tuple[int, list[int]]]:
    """(times, lengths) of best-fit decreasing over the histogram (index: length).

    Equal bins are one group: pieces of a length fill the fullest bins that take them, each as often as it can, so that the work follows the lengths, not the pieces."""
    capacity = len(histogram) - 1
    open_: list[list[tuple[int, tuple[tuple[int, int], ...]]]] = [[] for _ in range(capacity + 1)]  # by room: bins, and their (length, count)
    for x in np.flatnonzero(histogram)[::-1].tolist():
        n, room = int(histogram[x]), x
        while n:
            while room < capacity and not open_[room]:
                room += 1
            held, own = open_[room].pop() if open_[room] else (n, ())
            k = room // x
            full = min(held, n // k)
            if full:
                open_[room - k * x].append((full, (*own, (x, k))))
                n -= full * k
            used = full
            if used < held and 0 < n < k:
                open_[room - n * x].append((1, (*own, (x, n))))
                n, used = 0, used + 1
            if own and used < held:
                open_[room].append((held - used, own))
    return [(n, [x for x, k in own for _ in range(k)]) for groups in open_ for n, own in groups]


@dataclass
class Plan:
    """configurations: (times, lengths), in all every piece once; bound: no packing has fewer sequences; placed, rest: sequences by the program, and best-fit."""

    configurations: list[tuple[int, list[int]]]
    bound: int = 0
    placed: int = 0
    rest: int = 0


def fractional(lengths: np.ndarray, need: np.ndarray, capacity: int, weight: np.ndarray, rounds: int, rate: float, near: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(lower bound, configurations, how often each, log weights) of the covering program by multiplicative weights.

    The price of a length is its length times its weight. A round prices by the knapsack, for every length, the best configuration that holds it, and takes
    those whose value is within `near` of the best, each as much as its length's demand is worth. Weights then fall exponentially with what a round covers beyond the demand and rise
    with what it lacks, by steps that shrink. The plan is the average of the rounds but for the first third. Any prices give a bound: the worth of the demand over the best configuration's."""
    area = float((need * lengths).sum()) / capacity
    found: dict[bytes, float] = {}
    bound, skipped = 0.0, rounds // 3
    for t in range(rounds):
        value = np.exp(weight) * lengths / capacity
        best, pick = price(lengths, value, capacity)
        bound = max(bound, float((value * need).sum() / best[capacity]))
        chosen = np.flatnonzero(value + best[capacity - lengths] >= (1 - near) * best[capacity])
        rows = np.minimum(configurations(lengths, pick, chosen, capacity), need.astype(np.int64))
        amount = (need * value)[chosen]
        amount *= area / amount.sum()
        if t >= skipped:
            for x, row in zip(amount / (rounds - skipped), rows):
                key = row.tobytes()
                found[key] = found.get(key, 0.0) + x
        weight = weight - rate / (t + 5) * np.clip(amount @ rows / need - 1, -1, 4)
        weight -= weight.max()
    return bound, np.array([np.frombuffer(k, np.int64) for k in found]), np.array(list(found.values())), weight


def solve(histogram: np.ndarray, rounds: int = 80, rate: float = 0.7, near: float = 0.01, part: float = 0.2, phases: int = 20, grain: float = 0.002) -> Plan:
    """The plan for a histogram (index: length), the same way at every size.

    Rounding is iterated: a phase solves the program for what is left, rounds its configurations down to whole times (once at least), those first that the last prices find tightest,
    until `part` of the bound is placed, and goes on with the rest at the prices reached. After the phase at which that takes the fewest sequences the rest is packed best-fit."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    taken: list[tuple[int, list[int]]] = []
    placed = int(left[capacity])
    if placed:
        taken.append((placed, [capacity]))
        left[capacity] = 0
    weights = np.zeros(capacity + 1)
    bound, least, plan = placed, None, None
    for phase in range(phases):
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        need = left[lengths].astype(float)
        low, rows, amounts, weights[lengths] = fractional(lengths, need, capacity, weights[lengths], rounds, rate, near)
        if not phase:
            bound += int(np.ceil(low - 1e-6))
        value = np.exp(weights[lengths]) * lengths / capacity
        loose = np.floor((1 - rows @ value / price(lengths, value, capacity)[0][capacity]) / grain)
        now, rest = 0, left[lengths]
        for i in np.lexsort((-amounts, loose)):
            some = rows[i] > 0
            times = min(max(1, int(amounts[i])), int((rest[some] // rows[i][some]).min()))
            if times:
                taken.append((times, np.repeat(lengths, rows[i]).tolist()))
                rest -= times * rows[i]
                now += times
            if now >= part * low:
                break
        left[lengths] = rest
        placed += now
        residue = best_fit(left)
        total = placed + sum(n for n, _ in residue)
        if least is None or total <= least:
            least, plan = total, Plan(taken + residue, bound, placed, total - placed)
    return plan or Plan(taken, bound, placed)


def places(plan: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ranks, sorted by (length, first rank): length, first rank, first sequence, offset."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for times, items in plan:
        offset = 0
        for x in items:
            rows.append((x, taken[x], base, offset))
            taken[x] += times
            offset += x
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, how: Packing = Packing(), with_ids: bool = False, key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece; with_ids: and its ids."""
    cut = materialise(pieces(docs, how, with_ids, key=key), "pieces")
    counts = cut.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    counts = materialise(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "counts")
    histogram = np.zeros(how.capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # a row per length, capacity at most
        histogram[length] = n
    table = places(solve(histogram).configurations, how.capacity)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, base, offset = sent.value
        bounds = np.searchsorted(length, np.arange(how.capacity + 2))
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("place")).to_numpy()
            seq, off = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for v in np.unique(x):
                m = x == v
                lo, hi = bounds[v], bounds[v + 1]
                j = lo + np.searchsorted(first[lo:hi], rank[m], "right") - 1
                seq[m], off[m] = base[j] + rank[m] - first[j], offset[j]
            kept = [n for n in batch.schema.names if n != "place"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    own = ["key", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = cut.join(counts.select("part", "length", "before").hint("merge"), ["part", "length"]).select(*own, (F.col("before") + F.col("rank")).alias("place"))
    schema = T.StructType([cut.schema[c] for c in own] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).withColumnRenamed("key", key)
