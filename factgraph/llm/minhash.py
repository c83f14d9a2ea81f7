"""MinHash near-dedup: DartMinHash signatures, banded joining, exact check, connected classes.

A text is the weighted set of its five-word shingles (all words, where it has fewer), of weight 1 + ln(count). Darts are a fixed Poisson process over
elements x weight x rank: a dart hits the set if its weight coordinate lies below the element's weight, and of the darts that hash
to a coordinate of the signature the one of the least rank is kept. Two sets agree on a coordinate with a probability
equal to their weighted Jaccard similarity. Only ranks below about t / (total weight) are ever
thrown, so that the work a text needs falls from (weight x coordinates) to about (coordinates x log coordinates).

Texts that agree on a band are compared exactly, by the plain Jaccard similarity of their shingle sets. The two similarities differ where shingles repeat; the banding is wide enough
for that: a pair of weighted similarity 0.6 still shares a band 24 times of 25, one of 0.7 all but once in 700. Copies count once: everything after hashing is on distinct texts. In
each bucket the members are first compared with one central pivot (a star, never all pairs). Members of different classes that
still share a bucket are then all compared with each other within tiles of bounded size, which return only links that join classes,
so that no link of the banding is lost and rows grow in proportion to the group.

Cases: a text that is null or has no word is in no near-duplicate relation but to an equal text; repeated rows share a class; the class
id is the least doc_id of its texts (null only if all are). Texts are told apart by a 64-bit hash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import _text as tx
from factgraph.llm._spark import materialise

U64 = tx.U64


@dataclass(frozen=True)
class Banding:
    """With 24 bands of 4 rows, a pair at similarity 0.8 shares no band once in 300,000 times."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4
    seed: int = 1

    @property
    def size(self) -> int:
        return self.bands * self.rows


_FINE = 8  # ranks below 1 fall into intervals 2^-8, 2^-8, 2^-7, ... 2^-1 wide


def _interval(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bound and width of the q-th interval of ranks."""
    q = q.astype(np.int64)
    small = np.where(q == 0, 0.0, 2.0 ** (np.minimum(q, _FINE + 1) - 1.0 - _FINE))
    low = np.where(q <= _FINE, small, q - _FINE * 1.0)
    width = np.where(q == 0, 2.0**-_FINE, np.where(q <= _FINE, small, 1.0))
    return low, width


def _intervals_below(rank: np.ndarray) -> np.ndarray:
    """How many intervals begin below a rank."""
    return np.where(rank > 1, _FINE + np.ceil(rank), np.maximum(1, np.ceil(np.log2(np.maximum(rank, 2.0**-_FINE))) + _FINE + 1)).astype(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


_POISSON = {w: np.cumsum([np.exp(-w) * w**k / float(np.prod(np.arange(1, k + 1))) for k in range(12)]) for w in [2.0**-i for i in range(_FINE + 1)]}


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, n: int, how: Banding = Banding()) -> np.ndarray:
    """uint64 [n, size] of n weighted sets; (owner, element) pairs distinct, owner ascending. An empty set's row is all zeros."""
    k = how.size
    sig = np.zeros((n, k), U64)
    if not len(elements):
        return sig
    if weights is None:
        cells, cell_owner, limit = tx.mix(elements ^ U64(how.seed)), owner, np.ones(1)
        total = np.bincount(owner, minlength=n).astype(float)
        limit = np.ones(len(cells))
    else:
        copies = np.ceil(weights).astype(np.int64)
        pick = np.repeat(np.arange(len(elements)), copies)
        step = np.arange(len(pick)) - np.repeat(np.cumsum(copies) - copies, copies)
        cells, cell_owner = tx.mix(tx.mix(elements[pick] ^ U64(how.seed)) + step.astype(U64) * U64(0x9E3779B97F4A7C15)) if step.any() else tx.mix(elements[pick] ^ U64(how.seed)), owner[pick]
        limit = np.minimum(1.0, weights[pick] - step)
        total = np.bincount(owner, weights=weights, minlength=n)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12)
    todo = np.zeros(n, bool)
    todo[owner] = True
    while todo.any():
        use = todo[cell_owner]
        many = np.where(todo, _intervals_below(reach), 0)
        keep = np.full((n, k), np.inf)
        # in slices, so that memory is bounded however long a text is
        c, o, lim = cells[use], cell_owner[use], limit[use]
        per = many[o]
        at = 0
        ends = np.cumsum(per)
        while at < len(c):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_500_000, "right")))
            p = per[at:to]
            index = np.repeat(np.arange(at, to), p)
            q = np.arange(len(index)) - np.repeat(np.cumsum(p) - p, p)
            region = tx.mix(c[index] + (q.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F))
            u = _unit(region)
            low, width = _interval(q)
            level = np.where(q <= 1, _FINE, np.maximum(0, _FINE + 1 - q))
            darts = np.zeros(len(q), np.int64)
            sure = u >= np.exp(-width)
            hit = np.flatnonzero(sure)
            if len(hit):
                more = np.ones(len(hit), np.int64)
                for lv in np.unique(level[hit]):
                    m = level[hit] == lv
                    more[m] = np.searchsorted(_POISSON[2.0 ** -int(lv)], u[hit][m], "right")
                darts[hit] = more
                j = np.repeat(hit, more)
                d = np.arange(len(j)) - np.repeat(np.cumsum(more) - more, more)
                ident = tx.mix(region[j] + (d.astype(U64) + U64(1)) * U64(0xE7037ED1A0B428DB))
                rank = low[j] + width[j] * _unit(tx.mix(ident ^ U64(0x8EBC6AF09C88C6E3)))
                ok = (rank < reach[o[index[j]]]) & (_unit(tx.mix(ident ^ U64(0x589965CC75374CC3))) < lim[index[j]])
                ident, rank, who = ident[ok], rank[ok], o[index[j]][ok]
                spot = who * k + (ident % U64(k)).astype(np.int64)
                order = np.argsort(-rank, kind="stable")
                spot, ident, rank = spot[order], ident[order], rank[order]
                best = np.full(0, 0)
                flat_rank, flat_sig = keep.reshape(-1), sig.reshape(-1)
                best = rank < flat_rank[spot]
                flat_rank[spot[best]] = rank[best]  # ranks fall along the array: the last, least one stays
                flat_sig[spot[best]] = ident[best]
            at = to
        todo &= np.isinf(keep).any(1)
        reach = np.where(todo, reach * 2, reach)
    return sig


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their counts and texts, sorted by text and hash."""
    starts, ends, doc = tx.words(data, offsets)
    terms, owner = tx.window_hashes(tx.span_hashes(data, starts, ends), doc, width)
    order = np.lexsort((terms, owner))
    terms, owner = terms[order], owner[order]
    if not len(terms):
        return terms, np.zeros(0), owner
    fresh = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])])
    return terms[fresh], np.diff(np.r_[fresh, len(terms)]).astype(float), owner[fresh]


def weights(counts: np.ndarray) -> np.ndarray:
    """1 for a shingle that occurs once, more by the logarithm of how often it does."""
    return 1 + np.log(counts)


def band_keys(sig: np.ndarray, how: Banding) -> np.ndarray:
    """int64 [texts, bands]."""
    rows = sig.reshape(len(sig), how.bands, how.rows)
    h = np.zeros(rows.shape[:2], U64) + tx.mix(np.arange(how.bands, dtype=U64) + U64(how.seed * 1000))
    for r in range(how.rows):
        h = tx.mix(h * U64(0xD1342543DE82EF95) + rows[:, :, r])
    return h.view(np.int64)


def _bands(texts: DataFrame, how: Banding) -> DataFrame:
    """(node, bands array<long>) of (node, text); copies within a task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            data, offsets = tx.buffers(batch.column(1))
            for lo, hi in tx.pieces(offsets, 200_000):
                own = [i for i in range(lo, hi) if nodes[i] not in seen and not seen.add(nodes[i])]
                if len(seen) > 200_000:
                    seen.clear()
                if not own:
                    continue
                if len(own) < hi - lo:
                    d, o = tx.buffers(batch.column(1).take(pa.array(own)))
                else:
                    d, o = tx.cut(data, offsets, lo, hi)
                terms, counts, owner = shingles(d, o, how.width)
                full = np.unique(owner)
                if not len(full):
                    continue
                keys = band_keys(dart_signatures(terms, weights(counts), owner, len(own), how), how)[full]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[np.array(own)[full]]), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, how.bands, dtype=np.int32), keys.reshape(-1))], names=["node", "bands"])

    return texts.select("node", "text").mapInArrow(run, "node long, bands array<long>")


def _sets(texts: DataFrame, how: Banding) -> DataFrame:
    """(node, set array<long>): the distinct shingles, for the exact check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            for lo, hi in tx.pieces(offsets, 400_000):
                terms, _, owner = shingles(*tx.cut(data, offsets, lo, hi), how.width)
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(bounds, terms.view(np.int64))], names=["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>")


def _check(pairs: DataFrame, sets: DataFrame, how: Banding) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity reaches the bound."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(b, "b").join(a, "a")
        .where(F.least(F.size("sa"), F.size("sb")) >= how.similarity * F.greatest(F.size("sa"), F.size("sb")))
        .where(common >= how.similarity * (F.size("sa") + F.size("sb") - common))
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node of each connected component, for the nodes that have links.

    Least labels spread along the links and jump to the label's own label; the rounds needed grow with the logarithm of the diameter."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        fresh = materialise(low.join(jump, "next").select("node", F.least("next", "far").alias("new"), "comp"), "labels")
        changed = not fresh.where(F.col("new") != F.col("comp")).isEmpty()
        labels = fresh.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels


def _compare_tile(table: pa.Table, how: Banding) -> pa.Table:
    """Links between the guests and the members of one tile that join classes: a spanning forest of them, never all pairs.

    Overlaps are counted through the sorted elements of the members, for a bounded number of matches at a time."""
    role, node, comp = (table.column(c).to_numpy() for c in ("guest", "node", "comp"))
    sets = table.column("set").combine_chunks()
    values, bounds = sets.flatten().to_numpy(), np.r_[0, np.cumsum(np.diff(sets.offsets.to_numpy()))]
    size = np.diff(bounds)
    guests, members = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
    owner = np.repeat(np.arange(len(node)), size)
    own = role[owner] == 0
    elements, element_owner = values[own], owner[own]
    order = np.argsort(elements, kind="stable")
    elements, element_owner = elements[order], element_owner[order]
    place = np.zeros(len(node), np.int64)
    place[members] = np.arange(len(members))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    for g in guests:
        mine = values[bounds[g] : bounds[g + 1]]
        lo, hi = np.searchsorted(elements, mine, "left"), np.searchsorted(elements, mine, "right")
        counts = np.zeros(len(members), np.int64)
        n = hi - lo
        at = 0
        ends = np.cumsum(n)
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000, "right")))
            spots = np.repeat(lo[at:to] - (ends[at:to] - n[at:to] - (ends[at - 1] if at else 0)), n[at:to]) + np.arange(int(n[at:to].sum()))
            counts += np.bincount(place[element_owner[spots]], minlength=len(members))
            at = to
        near = members[counts >= how.similarity * (size[g] + size[members] - counts)]
        for m in near:
            x, y = root(int(comp[g])), root(int(comp[m]))
            if x != y:
                parent[x] = y
                found.append((int(node[g]), int(node[m])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _rest(shared: DataFrame, comps: DataFrame, sets: DataFrame, how: Banding, elements: int = 1_000_000) -> DataFrame:
    """Links (a, b) between classes that share a bucket: every such pair of texts is compared, in tiles, without being emitted.

    The largest class of a bucket is its host, the members of the bucket's other classes are guests of the host; guests are compared
    with all members of their host and with each other. Tiles hold about `elements` shingles on either side."""
    named = shared.select("band", "node").join(comps, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    named = materialise(named, "named")
    sizes = named.select("node", "comp").distinct().groupBy("comp").agg(F.count("*").alias("n"))
    hosts = named.select("band", "comp").distinct().join(sizes, "comp").groupBy("band").agg(F.max(F.struct("n", "comp")).alias("host"), F.count("*").alias("k")).where("k > 1").select("band", F.col("host.comp").alias("cell"))
    guests = named.join(hosts, "band").where(F.col("comp") != F.col("cell")).select("cell", "node", "comp").distinct()
    held = hosts.select("cell").distinct().join(named.select("node", "comp").distinct(), F.col("cell") == F.col("comp")).select("cell", "node", "comp")
    every = materialise(guests.withColumn("guest", F.lit(1)).unionByName(held.withColumn("guest", F.lit(0))).join(sets.select("node", F.size("set").alias("size")), "node"), "cells")
    tiles = F.ceil(F.coalesce(F.sum(F.when(F.col("guest") == 1, F.col("size"))), F.lit(1)) / elements)
    total = every.groupBy("cell").agg(F.greatest(tiles, F.lit(1)).alias("g"), F.greatest(F.ceil(F.sum("size") / elements), F.lit(1)).alias("m"))
    dealt = every.join(total, "cell")
    h = F.abs(F.xxhash64("node"))
    as_guest = dealt.where("guest = 1").select("cell", "node", "comp", F.lit(1).alias("guest"), (h % F.col("g")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j"))
    as_member = dealt.select("cell", "node", "comp", F.lit(0).alias("guest"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("i"), (h % F.col("m")).alias("j"))
    rows = as_guest.unionByName(as_member).join(sets, "node")
    return rows.groupBy("cell", "i", "j").applyInArrow(lambda t: _compare_tile(t, how), "a long, b long")


def near_components(docs: DataFrame, how: Banding = Banding(), text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(node, comp) of the texts that have a near duplicate, and (node, key), the least key of each text; node = text_node(text)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    named = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("node", text_node("text"))
    bands = materialise(_bands(named, how), "bands")
    spread = bands.dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    shared = materialise(spread.join(spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band"), "shared")
    # the pivot of a bucket is the member in the largest buckets: the text that a group of near copies was made from, if it is there
    weight = shared.groupBy("node").agg(F.sum("n").alias("w"))
    pivot = shared.select("band", "node").join(weight, "node").groupBy("band").agg(F.max(F.struct("w", "node")).alias("p")).select("band", F.col("p.node").alias("a"))
    star = shared.select("band", "node").join(pivot, "band").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()
    holder = materialise(named.groupBy("node").agg(F.min("key").alias("key")).join(weight.select("node"), "node"), "holders")
    # one plan at every size: small candidate tables would be broadcast, larger ones move the texts
    held = holder.select(F.col("node").alias("held"), F.col("key").alias("holder")).hint("merge")
    chosen = named.join(held, (F.col("node") == F.col("held")) & F.col("key").eqNullSafe(F.col("holder"))).select("node", "text")
    sets = materialise(_sets(chosen, how).dropDuplicates(["node"]), "sets")
    links = materialise(_check(star, sets, how), "links")
    comps = components(links)
    more = materialise(_rest(shared, comps, sets, how), "links")
    if not more.isEmpty():
        comps = components(links.union(more))
    return comps, holder


def near_classes(docs: DataFrame, how: Banding = Banding(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(node, class_id) of the texts that have a near duplicate."""
    comps, holder = near_components(docs, how, text, key)
    ids = comps.join(holder, "node")
    return ids.join(ids.groupBy("comp").agg(F.min("key").alias("class_id")), "comp").select("node", "class_id")


def text_node(column: str):
    return F.xxhash64(F.col(column))


def classes(docs: DataFrame, how: Banding = Banding(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and class_id of every row: equal or near-duplicate texts share the least doc_id among them."""
    found = near_classes(docs, how, text, key)
    # null texts are equal to each other and to nothing else, so they have a node apart from that of the empty text
    named = docs.select(F.col(key).alias(key), F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(text_node(text)).alias("node"))
    own = named.groupBy("node").agg(F.min(key).alias("own")).join(found, "node", "left").select("node", F.coalesce("class_id", "own").alias("class_id"))
    return named.join(own, "node").select(key, "class_id")


def keep_one(docs: DataFrame, how: Banding = Banding()) -> DataFrame:
    """One row of each class of texts, the one of the least doc_id (null after all others), with the columns of docs.

    Classes are told apart by their texts, so that unlike texts under one doc_id, or under none, all stay; of rows that repeat both doc_id and
    text, any one."""
    comps, _ = near_components(docs, how)
    node = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(text_node("text"))
    least = docs.select(node.alias("node"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")).alias("k")).groupBy("node").agg(F.min("k").alias("k"))
    named = least.join(comps, "node", "left")
    best = named.groupBy(F.coalesce("comp", "node").alias("class")).agg(F.min(F.struct("k", "node")).alias("b")).select(F.col("b.k.id").alias("_id"), F.col("b.node").alias("_node"))
    kept = docs.join(best, (node == F.col("_node")) & docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    repeated = kept.groupBy("doc_id", node.alias("_node")).count().where("count > 1").limit(1)
    return kept if repeated.isEmpty() else kept.withColumn("_node", node).dropDuplicates(["doc_id", "_node"]).drop("_node")
