"""Document fingerprints: SimHash over weighted word shingles, and search within a Hamming radius by block tables.

Each distinct shingle of three consecutive words (all words, where a text has fewer) hashes to `bits` signed votes,
weighted 1 + ln(count); a bit of the fingerprint is 1 where the votes are above zero. Likeness of two fingerprints is the cosine that
their share of differing bits estimates, 0 where they differ in half of the bits or more.

Cases: null counts as the empty text, whose fingerprint is all zeros; equal texts have equal fingerprints; a likeness
of two empty texts is 1. Very long texts are fingerprinted whole. The order of documents is by doc_id, nulls first,
then by text, so that repeated rows have a defined neighbour. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import _text as tx
from factgraph.llm._spark import materialise

BITS, WIDTH, CHUNK = 128, 3, 150_000


def fingerprints(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, width: int = WIDTH) -> np.ndarray:
    """uint8 [texts, bits / 8] of the texts of a batch."""
    n = len(offsets) - 1
    out = np.zeros((n, bits // 8), np.uint8)
    for lo, hi in tx.pieces(offsets, CHUNK):
        d, o = tx.cut(data, offsets, lo, hi)
        starts, ends, doc = tx.words(d, o)
        terms, owner = tx.window_hashes(tx.span_hashes(d, starts, ends), doc, width)
        if not len(terms):
            continue
        order = np.lexsort((terms, owner))
        terms, owner = terms[order], owner[order]
        fresh = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])])
        weight = 1 + np.log(np.diff(np.r_[fresh, len(terms)]), dtype=np.float32)
        terms, owner = terms[fresh], owner[fresh]
        lanes = np.stack([tx.mix(terms + tx.U64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)) for i in range(bits // 64)], 1)
        signs = np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        votes = np.add.reduceat(signs * weight[:, None], first, axis=0)
        total = np.add.reduceat(weight, first)
        out[lo + owner[first]] = np.packbits(2 * votes > total[:, None] * (1 + 1e-6), axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 0 to 1."""
    differ = np.unpackbits(a ^ b, axis=1).mean(1)
    return np.clip(np.cos(np.pi * differ), 0.0, 1.0)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def fingerprint_rows(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", bits: int = BITS) -> DataFrame:
    """The columns in `keep` and fingerprint, in hexadecimal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(*tx.buffers(batch.column(batch.schema.get_field_index(text))), bits)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(_hex(found), pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [T.StructField("fingerprint", T.StringType())]))


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3, bits: int = BITS, blocks: int | None = None, column: str = "fingerprint") -> DataFrame:
    """Pairs (query_fingerprint, fingerprint, distance) of *distinct* fingerprints at most `radius` bits apart, all of them.

    The bits are cut into blocks; fingerprints that differ in at most `radius` bits agree on some blocks - radius of them. One
    table per choice of those blocks is permuted to lead with them, and joined by equality. Join the result back by
    fingerprint to reach the rows; copies are never expanded into pairs here."""
    blocks = blocks or radius + 2
    if not radius < blocks <= bits // 8:
        raise ValueError("blocks must exceed radius and hold whole bytes")
    edges = [2 * (i * (bits // 8) // blocks) for i in range(blocks + 1)]
    choices = list(itertools.combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame, name: str) -> DataFrame:
        fp = F.col(column)
        keys = [F.struct(F.lit(t).alias("t"), F.concat(*[F.substring(fp, edges[b] + 1, edges[b + 1] - edges[b]) for b in c]).alias("k")) for t, c in enumerate(choices)]
        return df.select(column).where(fp.isNotNull()).distinct().select(fp.alias(name), F.explode(F.array(*keys)).alias("x")).select(name, F.xxhash64("x.t", "x.k").alias("key"))

    def apart(a: str, b: str):
        words = [F.bit_count(F.conv(F.substring(a, i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i, 8), 16, 10).cast("long"))) for i in range(1, bits // 4 + 1, 8)]
        return sum(words[1:], words[0])

    pairs = tables(queries, "query_fingerprint").join(tables(corpus, column), "key")
    return pairs.select("query_fingerprint", column, apart("query_fingerprint", column).cast("int").alias("distance")).where(F.col("distance") <= radius).distinct()


def radius_counts(queries: DataFrame, corpus: DataFrame, radius: int = 3, bits: int = BITS, blocks: int | None = None, column: str = "fingerprint", tile: int = 20_000) -> DataFrame:
    """(fingerprint, near) of each distinct fingerprint of `queries`: how many rows of `corpus` have another fingerprint at most `radius` bits apart, all of them.

    Block tables as in `within_radius`, but no pair is made: the queries and the rows that agree with one on a table's key are compared where they meet, in tiles of at most about `tile` of
    either, and a tile gives a count for each of its queries. A pair that agrees on several tables counts in the first alone."""
    blocks = blocks or radius + 2
    if not radius < blocks <= bits // 8:
        raise ValueError("blocks must exceed radius and hold whole bytes")
    edges = [i * (bits // 8) // blocks for i in range(blocks + 1)]
    choices = list(itertools.combinations(range(blocks), blocks - radius))

    def keyed(df: DataFrame, *more: str) -> DataFrame:
        fp = F.unhex(column)
        keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[F.substring(fp, edges[b] + 1, edges[b + 1] - edges[b]) for b in c]).alias("key")) for t, c in enumerate(choices)]
        return df.select(fp.alias("fp"), *more, F.explode(F.array(*keys)).alias("x")).select("x.t", "x.key", "fp", *more)

    asked = keyed(queries.select(column).where(F.col(column).isNotNull()).distinct())
    held = keyed(corpus.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")), "n")
    met = materialise(held.join(asked.select("t", "key").distinct().hint("merge"), ["t", "key"], "left_semi"), "met")
    cells = asked.groupBy("t", "key").agg(F.ceil(F.count("*") / tile).alias("qs")).join(met.groupBy("t", "key").agg(F.ceil(F.count("*") / tile).alias("ms")), ["t", "key"])
    spot = lambda n: F.pmod(F.xxhash64("fp"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt_q = asked.join(cells, ["t", "key"]).select("t", "key", spot("qs").alias("i"), every("ms").alias("j"), "fp", F.lit(0).cast("long").alias("n"))
    dealt_m = met.join(cells, ["t", "key"]).select("t", "key", every("qs").alias("i"), spot("ms").alias("j"), "fp", "n")

    def compare(t: int, fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ask, have, weight = fp[n == 0], fp[n > 0], n[n > 0]
        near = np.zeros(len(ask), np.int64)
        for lo in range(0, len(have), 4096):
            part = have[lo : lo + 4096]
            for k in range(len(ask)):
                differ = part ^ ask[k]
                hits = np.flatnonzero(np.bitwise_count(differ).sum(1) <= radius)
                hits = hits[differ[hits].any(1)]
                if not len(hits):
                    continue
                same = np.stack([~differ[hits, edges[b] : edges[b + 1]].any(1) for b in range(blocks)], 1)
                agree = np.stack([same[:, c].all(1) for c in map(list, choices)], 1)
                near[k] += weight[lo + hits[agree.argmax(1) == t]].sum()
        return ask[near > 0], near[near > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells follow each other; one may go on in the next batch."""
        cell, fp, n = np.zeros((0, 4), np.int64), np.zeros((0, bits // 8), np.uint8), np.zeros(0, np.int64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cell = np.r_[cell, np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)]
                fp = np.r_[fp, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, bits // 8)]
                n = np.r_[n, batch.column(5).to_numpy()]
            if not len(n):
                continue
            first = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)])
            ends = np.r_[first[1:], len(n)] if batch is None else first[1:]
            found = [compare(int(cell[a, 0]), fp[a:b], n[a:b]) for a, b in zip(first, ends)]
            to = int(ends[-1]) if len(ends) else 0
            cell, fp, n = cell[to:], fp[to:], n[to:]
            if any(len(x) for x, _ in found):
                yield pa.RecordBatch.from_arrays([pa.array(_hex(np.concatenate([x for x, _ in found])), pa.string()), pa.array(np.concatenate([y for _, y in found]))], names=[column, "near"])

    dealt = dealt_q.unionByName(dealt_m).repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    rows = dealt.mapInArrow(run, f"{column} string, near long")
    asked_all = queries.select(column).where(F.col(column).isNotNull()).distinct().withColumn("near", F.lit(0).cast("long"))
    rows = rows.unionByName(asked_all)
    return rows.groupBy(column).agg(F.sum("near").alias("near"))


def with_near_rows(scored: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of `with_edits` and near_rows: for the query set, every doc_id divisible by 20, how many other rows have a fingerprint at most `radius` bits from this one; null
    for all others."""
    scored = materialise(scored, "fingerprints")
    chosen = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    found = radius_counts(scored.where(chosen), scored, radius).select(F.col("fingerprint").alias("_f"), "near")
    copies = scored.groupBy(F.col("fingerprint").alias("_c")).agg((F.count("*") - 1).alias("copies"))
    asked = scored.where(chosen).join(found, F.col("fingerprint") == F.col("_f"), "left").join(copies, F.col("fingerprint") == F.col("_c"), "left")
    return asked.select(*scored.columns, (F.coalesce("near", F.lit(0)) + F.col("copies")).cast("long").alias("near_rows")).unionByName(scored.where(~chosen).withColumn("near_rows", F.lit(None).cast("long")))


def _ordered_parts(docs: DataFrame, rows_per_part: int, parts_most: int = 10_000) -> DataFrame:
    """docs in parts of neighbouring doc_id, each closed by a copy of the next part's first row (the last by the first part's).

    Columns: part, again (1 for a copy), doc_id, text. The bounds are quantiles of doc_id. They are part of the plan, and the first ids of the parts are
    broadcast, so there are `parts_most` at most; a part is streamed in order, so that its size takes no memory."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.count()
    n = max(1, min(parts_most, -(-size // rows_per_part)))
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or [])) if n > 1 else []
    part = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(b) for b in bounds])
        part = F.coalesce(F.expr("0") + F.size(F.filter(edges, lambda b: b < F.col("doc_id"))), F.lit(0)) if len(bounds) <= 64 else F.coalesce(_searched(edges), F.lit(0))
    rows = rows.select(part.cast("int").alias("part"), "doc_id", "text")
    # the first row of each part: its id from a small aggregate, then its text by a join on that id
    first = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"))
    heads = first.select("part", F.col("least.doc_id").alias("doc_id"), F.lead("part").over(Window.orderBy("part")).alias("after"), F.lag("part").over(Window.orderBy("part")).alias("before"), F.max("part").over(Window.partitionBy()).alias("last"))
    head_rows = rows.alias("r").join(F.broadcast(heads.alias("h")), (F.col("r.part") == F.col("h.part")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")))
    head_text = head_rows.groupBy(F.coalesce("h.before", "h.last").alias("part"), F.col("r.doc_id").alias("doc_id")).agg(F.min("r.text").alias("text"))
    return rows.select("part", F.lit(0).alias("again"), "doc_id", "text").unionByName(head_text.select("part", F.lit(1).alias("again"), "doc_id", "text"))


def _searched(edges: Column) -> Column:
    """Number of sorted edges below doc_id, by halving."""
    lo = F.aggregate(
        F.sequence(F.lit(1), F.lit(15)),
        F.struct(F.lit(0).alias("a"), F.size(edges).alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s).otherwise(
            F.when(F.get(edges, ((s["a"] + s["b"]) / 2).cast("int")) < F.col("doc_id"), F.struct((((s["a"] + s["b"]) / 2).cast("int") + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), ((s["a"] + s["b"]) / 2).cast("int").alias("b")))
        ),
    )
    return lo["a"]


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the first of another text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def with_edits(docs: DataFrame, bits: int = BITS, rows_per_part: int = 2_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likenesses. One shuffle of the texts, by ranges of doc_id."""
    key = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple | None = None  # part, doc_id, text of the row that still lacks its neighbour

        def out(rows: list[tuple]) -> pa.RecordBatch:
            texts = [r[1] for r in rows]
            edits = [edit(r[1], r[2]) for r in rows]
            # a row's neighbour is mostly the next row here: each text is fingerprinted once
            once: dict[str, int] = {}
            own, following, changed = ([once.setdefault(x, len(once)) for x in group] for group in (texts, [r[2] for r in rows], edits))
            found = fingerprints(*tx.buffers(pa.array(list(once), pa.large_string())), bits)
            prints = [found[own], found[changed], found[following]]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], id_type), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()),
                 pa.array(_hex(prints[0])), pa.array(_hex(prints[1])), pa.array(likeness(prints[0], prints[1])), pa.array(likeness(prints[0], prints[2]))],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        id_type = None
        rows, weight = [], 0
        for whole in batches:
            id_type = whole.column(2).type
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                for part, again, doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                    if pending and pending[0] == part:
                        rows.append((pending[1], pending[2], text))
                        weight += len(pending[2]) + len(text)
                        if weight > 400_000:
                            yield out(rows)
                            rows, weight = [], 0
                    pending = None if again else (part, doc, text)
        if rows:
            yield out(rows)

    parts = _ordered_parts(docs, rows_per_part)
    schema = T.StructType([T.StructField("doc_id", key.dataType)] + list(T.StructType.fromDDL(EDITED).fields[1:]))
    return parts.repartition("part").sortWithinPartitions("part", "again", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, schema)
