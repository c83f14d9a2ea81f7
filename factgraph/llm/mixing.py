"""Mixing sources to target weights: fixed-length blocks, multinomial shard counts, permuted block indices.

The words of a source, in a fixed pseudorandom order of its documents, form one stream that is cut into blocks of
`block` words. A source's target says how many words it gives; whole passes over it take every block, and a last partial pass takes as
many blocks as are needed, the final one trimmed, so that the words taken equal the target rounded down. The number of output shards, a power of two, follows from the whole mix.
Each source deals its slots to all of them by a multinomial draw of equal chances, so that a shard's counts are a multinomial draw in proportion to the sources' slots
and the totals stay exact; the draw is made by halves (a binomial at each node of a tree over the shards), of which only the path to a slot's shard is evaluated. Slot j of a pass is mapped to a block by a pseudorandom
permutation (a Feistel network with cycle walking), evaluated where it is needed and never stored. Blocks are joined by index.

Everything is drawn from hashes and seeded generators of the data, so that reruns agree, whatever the partitioning.

Cases: a null text has no words; a null source is a source of its own, the last; a source without words has target 0; repeated rows
count each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import _text as tx
from factgraph.llm._spark import materialise

WORD_GAP = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """share: words of the mix against words of the input; most: how often a source may be taken; weights repeat over the sources in order; shard_slots: slots of an output shard at most, on average."""

    share: float = 1.5
    most: float = 2.0
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    block: int = 256
    shard_slots: int = 4096
    rows_per_chunk: int = 20_000
    seed: int = 7


def n_words(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), WORD_GAP), "")).cast("long")


def targets(sizes: DataFrame, how: Mix = Mix()) -> DataFrame:
    """source, source_size, target of (source, source_size), a row per source.

    Shares in proportion to weight, none above `most` times its size, with the excess shared again by weight until none is above:
    the sources that stop are those of the least size per weight, so the stopping point is found by running sums in that order."""
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in how.weights]), (rank % len(how.weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"))
    s = s.withColumn("most", how.most * F.col("source_size"))
    upto = every.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.select("*", (how.share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("rest"), F.sum("w").over(upto.rowsBetween(0, Window.unboundedFollowing)).alias("w_rest"), F.row_number().over(upto).alias("place"))
    s = s.withColumn("stops", F.col("rest") * F.col("w") / F.col("w_rest") > F.col("most"))
    # after the first that does not stop, none does; sources may tie
    open_ = F.min(F.when(~F.col("stops"), F.struct("place", (F.col("rest") / F.col("w_rest")).alias("level")))).over(every)
    s = s.withColumn("level", open_["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("w"))).alias("target"))


def _feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at x."""
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    mask = tx.U64((1 << half) - 1)
    out = x.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        v = out[todo]
        left, right = v >> tx.U64(half), v & mask
        for r in range(4):
            left, right = right, left ^ (tx.mix(right + tx.U64((key * 4 + r) * 0x9E3779B97F4A7C15 % 2**64)) & mask)
        out[todo] = (left << tx.U64(half)) | right
        todo = out >= tx.U64(n)
    return out.astype(np.int64)


def _key(source: str | None, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(f"{seed}:{'null' if source is None else 's' + source}".encode(), digest_size=7).digest(), "little")


#: Nodes of up to so many slots count coins; the few larger ones draw from a generator each.
_COINS = 4096


def _halves(node: np.ndarray, size: np.ndarray, level: int, key: int) -> np.ndarray:
    """How many of each node's slots go to its left half: a binomial draw of (size, 1/2) that depends on key, level and node alone. Small nodes count the set bits among as
    many hashed ones, all together."""
    left = np.zeros(len(node), np.int64)
    big = np.flatnonzero(size > _COINS)
    for i in big:
        left[i] = np.random.default_rng((key, level, int(node[i]))).binomial(int(size[i]), 0.5)
    todo = np.flatnonzero(size <= _COINS)
    seed = tx.mix(tx.mix(node.astype(np.uint64) + tx.U64((key * 0x9E3779B97F4A7C15 + level) % 2**64)) ^ tx.U64(level + 1))
    at = 0
    while len(todo):
        rest = np.minimum(size[todo] - 64 * at, 64).astype(np.uint64)
        coins = tx.mix(seed[todo] + tx.U64((at + 1) * 0xD1342543DE82EF95 % 2**64))
        kept = np.where(rest > 0, coins >> ((tx.U64(64) - rest) % tx.U64(64)), 0)
        left[todo] += np.bitwise_count(kept)
        at += 1
        todo = todo[size[todo] > 64 * at]
    return left


def deal(rank: np.ndarray, n: int, levels: int, key: int) -> np.ndarray:
    """The shard, of 2 ** levels, of each rank of 0 to n - 1: a multinomial draw of the shards' counts, in which equal ranks and keys agree wherever they are evaluated."""
    node, size, at = np.zeros(len(rank), np.int64), np.full(len(rank), n, np.int64), rank.astype(np.int64)
    for level in range(levels):
        _, first, back = np.unique(node, return_index=True, return_inverse=True)
        left = _halves(node[first], size[first], level, key)[back]
        right = at >= left
        node = 2 * node + right
        at, size = np.where(right, at - left, at), np.where(right, size - left, left)
    return node


SLOTS = "source string, shard int, shards int, slot long, pass int, block long, n_words long"


def slots(plan: DataFrame, how: Mix = Mix()) -> DataFrame:
    """The mix as rows: source, output shard, number of shards, slot within the source, pass, block index, words taken from the block.

    plan: source, source_size, target. A source's slots are cut into ranges, so that no task makes more than about a million."""

    step = 1 << 20
    every = plan.where("source_size > 0").agg(F.sum(F.ceil(F.floor("target") / how.block))).first()[0] or 0
    levels = max(0, -(-int(every) // how.shard_slots) - 1).bit_length()
    total = F.expr(f"cast(ceil(target / {how.block}) as bigint) + 2")
    ranges = plan.where("source_size > 0").select("source", "source_size", F.floor("target").cast("long").alias("take"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(total - 1, F.lit(0)), F.lit(step).cast("long"))).alias("at"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, size, take, at in batch.itertuples(index=False):
                source = None if source is None or source != source else source
                size, take = int(size), int(take)
                blocks = -(-size // how.block)
                passes, rest = divmod(take, size)
                key = _key(source, how.seed)
                # the slots of the last pass: whole blocks in permuted order, until `rest` words are taken
                short = size - (blocks - 1) * how.block
                n = passes * blocks + min(blocks, -(-rest // how.block) + 1) * (rest > 0)
                for lo in range(int(at), min(int(at) + step, n), 1 << 17):
                    j = np.arange(lo, min(lo + (1 << 17), int(at) + step, n))
                    which = j // blocks
                    block = np.zeros(len(j), np.int64)
                    for p in np.unique(which):
                        m = which == p
                        block[m] = _feistel((j[m] % blocks), blocks, key + int(p) * 1000003)
                    words = np.where(block == blocks - 1, short, how.block)
                    if rest and which[-1] == passes:
                        m = which == passes
                        here = j[m] - passes * blocks
                        # words before this slot in the pass: a full block each, but for the short one if it came earlier
                        spot = _inverse_short(blocks, key + passes * 1000003)
                        before = here * how.block - (here > spot) * (how.block - short)
                        words[m] = np.clip(rest - before, 0, words[m])
                    ok = words > 0
                    shard = deal(_feistel(j, n, key + 17), n, levels, key)
                    yield pd.DataFrame({"source": pd.Series([source] * int(ok.sum()), dtype=object), "shard": shard[ok].astype(np.int32), "shards": np.int32(1 << levels), "slot": j[ok], "pass": which[ok].astype(np.int32), "block": block[ok], "n_words": words[ok]})

    return ranges.repartition(F.col("source"), F.col("at")).mapInPandas(run, SLOTS)


def _inverse_short(blocks: int, key: int) -> int:
    """Where the permutation puts the last block, by walking it backwards."""
    half = max(1, (max(1, (blocks - 1).bit_length()) + 1) // 2)
    mask = (1 << half) - 1
    v = blocks - 1
    while True:
        left, right = v >> half, v & mask
        for r in reversed(range(4)):
            round_ = int(tx.mix(np.array([(left + (key * 4 + r) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) & mask
            left, right = right ^ round_, left
        v = (left << half) | right
        if v < blocks:
            return v


def streams(sized: DataFrame, how: Mix = Mix()) -> DataFrame:
    """doc_id, source, size, row and start of (doc_id, source, size, h, row): h a hash of the document, start the words before the document in its source's stream.

    The order is by a hash of the document within chunks of about `rows_per_chunk` rows, so that no window holds a source."""
    rows = sized.count()
    chunks = max(1, -(-rows // how.rows_per_chunk))
    keyed = sized.select("*", F.pmod("h", F.lit(chunks)).cast("int").alias("chunk"))
    sums = keyed.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    before = sums.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("source", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = keyed.withColumn("local", within)
    return local.join(before, F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2"))).select("doc_id", "source", "size", "row", (F.col("base") + F.col("local")).alias("start"))


def mix(docs: DataFrame, how: Mix = Mix(), text: str = "text", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """row: a column that numbers the rows, if there is one. Returns (documents, blocks). documents: doc_id, size, source, source_size, target, taken, row, first_shard (the output shard of its first words that are taken, null for none); blocks: the slots of `slots` with the documents whose
    words they hold: doc_id, first word in the document, words."""
    row = F.col(row) if row else F.monotonically_increasing_id()
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64("doc_id", text, F.lit(how.seed)).alias("h"), row.alias("row")), "sized")
    plan = materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), how), "targets")
    stream = materialise(streams(sized, how), "stream")
    chosen = slots(plan, how)
    b = how.block
    held = stream.where("size > 0").select("doc_id", "row", "source", "start", "size", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))).alias("block"))
    held = held.select("doc_id", "row", "source", "block", F.greatest("start", F.col("block") * b).alias("lo"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b).alias("hi"), "start")
    c = chosen.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "shard", "shards", "slot", "pass", "n_words").hint("merge")  # Spark would take the slots to be as few as the sources
    parts = held.join(c, held["source"].eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    end = F.least(F.col("hi"), F.col("block") * b + F.col("n_words"))
    blocks = parts.where(end > F.col("lo")).select("source", "shard", "shards", "slot", "pass", "block", "doc_id", "row", (F.col("lo") - F.col("start")).alias("first_word"), (end - F.col("lo")).alias("n_words"))
    taken = blocks.groupBy(F.col("row").alias("r2")).agg(F.sum("n_words").alias("taken"), F.min(F.struct("first_word", "pass", "shard")).alias("at")).hint("merge")
    p = plan.select(F.col("source").alias("s3"), "source_size", "target")
    documents = sized.join(taken, F.col("row") == F.col("r2"), "left").join(p, sized["source"].eqNullSafe(F.col("s3"))).select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "row", F.col("at.shard").alias("first_shard"))
    return documents, blocks


def taken_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The words first to first + n - 1 of each span with the white space between them; spans that touch are one, others get a line each."""
    joined: list[list[int]] = []
    for first, n in sorted(spans):
        if joined and first <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], first + n)
        else:
            joined.append([first, first + n])
    words = [m.span() for m in _WORD.finditer(text)]
    if joined and joined[0][0] == 0 and joined[0][1] >= len(words):
        return text
    return "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in joined)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_rows(docs: DataFrame, how: Mix = Mix(), text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The mix as documents with the columns of docs, whatever their names: a row for each pass that takes words of a document, holding those words.

    Rows come in the order of the output shards, each where the block of its first words is, so that any run of rows carries the target weights, however long the documents are."""
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    base = materialise(docs.toDF(*own).withColumn("row", F.monotonically_increasing_id()), "base")
    named = {c: F.col(own[names.index(c)]).alias(c) for c in ("doc_id", "source", text)}
    _, blocks = mix(base.select(*named.values(), F.col("row").alias("_row")), how, text, "_row")
    spans = blocks.groupBy(F.col("row").alias("r"), "pass").agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans"), F.min(F.struct("first_word", "shard", "slot", "shards")).alias("at"))
    chosen = base.join(spans, F.col("row") == F.col("r")).select(*own, "spans", "at", "row", "pass")
    at_text, at_length = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = [taken_text(t, [(x["first_word"], x["n_words"]) for x in s]) for t, s in zip(batch.column(at_text).to_pylist(), batch.column(len(own)).to_pylist())]
                columns = list(batch.columns)
                columns[at_text] = pa.array(made, pa.string())
                if at_length is not None:
                    columns[at_length] = pa.array([len(t) for t in made], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns[: len(own)], *columns[len(own) + 1 :]], names=[*own, "at", "row", "pass"])

    kinds = {at_text: T.StringType(), at_length: T.LongType()}
    fields = [T.StructField(c, kinds.get(i, chosen.schema[c].dataType)) for i, c in enumerate(own)]
    rows = chosen.mapInArrow(run, T.StructType([*fields, *[chosen.schema[c] for c in ("at", "row", "pass")]]))
    # a run of shards is a partition; its number is known beforehand, so that nothing is sampled
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionById(parts, F.floor(F.col("at.shard") * parts / F.col("at.shards")).cast("int"))
    return dealt.sortWithinPartitions("at.shard", "at.slot", "row", "pass").select(*own).toDF(*names)
