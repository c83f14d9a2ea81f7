"""Text and vector search."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75


def text_match(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents whose text contains every term, whatever the case; terms of fewer than three characters match nothing."""
    if not terms or any(len(t) < 3 for t in terms):
        return docs.where(F.lit(False))
    low = F.lower("text")
    keep = F.lit(True)
    for t in terms:
        keep = keep & low.contains(t.lower())
    return docs.where(keep)


def trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.char_length(low) >= 3, F.transform(F.sequence(F.lit(1), F.char_length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigram_bm25(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """doc_id and score of the documents that contain the query, best first: BM25 over trigrams.

    Postings are made for the query's trigrams alone, by counting within each document: no trigram of the corpus is shuffled."""
    wanted = sorted({query.lower()[i : i + 3] for i in range(len(query) - 2)})
    return _scored(docs, F.lower("text").contains(query.lower()), wanted, limit, "doc_id")


def _scored(docs: DataFrame, hit: Column, wanted: list[str], limit: int, key: str) -> DataFrame:
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    low = F.lower("text")
    # overlapping occurrences: a text splits at a look-ahead once for each
    counts = [F.size(F.regexp_extract_all(low, F.concat(F.lit("(?=("), F.lit(_quoted(g)), F.lit("))")), 1)).alias(f"c{i}") for i, g in enumerate(wanted)]
    rows = docs.select(key, hit.alias("hit"), F.greatest(F.char_length(low) - 2, F.lit(0)).alias("n"), *counts)
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.greatest(F.log((F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"c{i}") * (K1 + 1) / (F.col(f"c{i}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return rows.where("hit").join(F.broadcast(stats)).select(key, score.alias("score")).orderBy(F.round("score", 6).desc(), key).limit(limit)  # stats is one row


def parse_query(query: str) -> tuple:
    """The tree of a text query: words and "phrases" next to each other or joined by AND must all be there, OR binds less, NOT more (a NOT b: a without b); parentheses group."""
    tokens = re.findall(r'"[^"]*"|[()]|[^\s()"]+', query)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def either():
        nonlocal at
        node = both()
        while peek() == "OR":
            at += 1
            node = ("or", node, both())
        return node

    def both():
        nonlocal at
        node = without()
        while peek() not in (None, "OR", ")"):
            at += peek() == "AND"
            node = ("and", node, without())
        return node

    def without():
        nonlocal at
        node = term()
        while peek() == "NOT":
            at += 1
            node = ("not", node, term())
        return node

    def term():
        nonlocal at
        t = peek()
        if t is None or t in ("AND", "OR", "NOT", ")"):
            raise ValueError(f"a word is missing in {query!r}")
        at += 1
        if t != "(":
            return ("term", t.strip('"').lower())
        node = either()
        if peek() != ")":
            raise ValueError(f"a parenthesis is open in {query!r}")
        at += 1
        return node

    tree = either()
    if at < len(tokens):
        raise ValueError(f"a parenthesis too many in {query!r}")
    return tree


def terms_of(tree: tuple) -> list[str]:
    """The terms that a match must or may have, without those that it must not."""
    if tree[0] == "term":
        return [tree[1]]
    return terms_of(tree[1]) + ([] if tree[0] == "not" else terms_of(tree[2]))


def matches(tree: tuple, text: str = "text") -> Column:
    """Whether a text answers a query; a term is any run of characters, whatever their case, and one of fewer than three matches nothing."""
    if tree[0] == "term":
        return F.lower(text).contains(tree[1]) if len(tree[1]) >= 3 else F.lit(False)
    a, b = matches(tree[1], text), matches(tree[2], text)
    return a | b if tree[0] == "or" else a & ~b if tree[0] == "not" else a & b


def ranked(docs: DataFrame, query: str, limit: int = 50, key: str = "doc_id") -> DataFrame:
    """key and score of the documents that answer a query, best first: BM25 over the trigrams of its terms."""
    tree = parse_query(query)
    wanted = sorted({t[i : i + 3] for t in terms_of(tree) for i in range(len(t) - 2)})
    return _scored(docs, matches(tree), wanted, limit, key)


def filtered(facts: DataFrame, types: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, patient: str | None = None) -> DataFrame:
    """Facts of these types, from a time on and before another (compared as text), of a patient."""
    keep = F.lit(True)
    keep = keep & F.col("type").isin(*types) if types else keep
    keep = keep & (F.col("ts") >= date_from) if date_from else keep
    keep = keep & (F.col("ts") < date_to) if date_to else keep
    return facts.where(keep & (F.col("patient_root") == patient) if patient else keep)


def matched_tags(facts: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """The facts that have one of the wanted tags at least, with matched_tags in the order asked for."""
    held = tags.where(F.col("tag").isin(*wanted)).groupBy(F.col("fact_id").alias("_f")).agg(F.collect_set("tag").alias("_t"))
    asked = F.array(*[F.lit(t) for t in dict.fromkeys(wanted)])
    return facts.join(held, F.col("fact_id") == F.col("_f")).withColumn("matched_tags", F.filter(asked, lambda t: F.array_contains("_t", t))).drop("_f", "_t")


def first_patient(anchors: DataFrame) -> DataFrame:
    """The anchors of the patient of each query's first anchor by id (query, fact_id, patient_root); shared facts if that one is shared."""
    first = anchors.groupBy(F.col("query").alias("_q")).agg(F.min(F.struct("fact_id", "patient_root")).alias("_x"))
    on = (F.col("query") == F.col("_q")) & F.col("patient_root").eqNullSafe(F.col("_x.patient_root"))
    return anchors.join(first, on).drop("_q", "_x")


def anchors(index: DataFrame, tags: DataFrame, query: str | None = None, wanted: list[str] | None = None, types: list[str] | None = None, date_from: str | None = None, date_to: str | None = None, patient: str | None = None,
            near: DataFrame | None = None, limit: int = 50, post_limit: bool = False, texts: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """fact_id, patient_root, by_text, distance, matched_tags of the facts that a search starts from: the best texts, or, without a query, all that have a tag; and the nearest
    vectors (near: fact_id, distance). Filters hold before the limit, after it with post_limit. index: fact_id, patient_root, type, ts, text; texts: finds the best among given facts (fact_id) by other means, an index; keep: more columns of the index."""
    if not query and not wanted:
        raise ValueError("a search needs a query or tags")
    chosen = filtered(index, types, date_from, date_to, patient)
    if not query:
        # the tags decide: who has one is joined once, and what is near adds its distance
        held = matched_tags(chosen.select("fact_id", "patient_root", *keep), tags, wanted).withColumn("by_text", F.lit(True))
        if near is None:
            return held.select("fact_id", "patient_root", *keep, "by_text", F.lit(None).cast("double").alias("distance"), "matched_tags")
        far = near.groupBy(F.col("fact_id").alias("id")).agg(F.min("distance").alias("distance"))
        return held.join(far, F.col("fact_id") == F.col("id"), "left").select("fact_id", "patient_root", *keep, "by_text", "distance", "matched_tags")
    among = index if post_limit else chosen
    best = (texts(among.select("fact_id")) if texts else ranked(among, query, limit, "fact_id")).select(F.col("fact_id").alias("id"))
    far = near.select(F.col("fact_id").alias("id"), "distance") if near is not None else best.select("id", F.lit(None).cast("double").alias("distance")).limit(0)
    hits = hybrid(best, far)
    rows = chosen.select("fact_id", "patient_root", *keep).join(hits, F.col("fact_id") == F.col("id")).drop("id")
    return matched_tags(rows, tags, wanted) if wanted else rows.withColumn("matched_tags", F.array().cast("array<string>"))


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, patient: str | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """fact_id and distance of the k nearest of vectors (fact_id, patient_root, embedding), nearest first, then without the hidden ones."""
    rows = vectors.where(F.col("patient_root") == patient) if patient else vectors
    asked = F.array(*[F.lit(float(x)) for x in query])
    best = rows.select("fact_id", F.round(l2(F.col("embedding"), asked), 6).alias("distance")).orderBy("distance", "fact_id").limit(k)
    return best.join(hidden.select("fact_id"), "fact_id", "left_anti") if hidden is not None else best


def _quoted(g: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in g)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


#: MB of numbers of a slice of the vectors and of a block of the queries; the larger they are, the less is moved.
SLICE_MB, BLOCK_MB = 8, 8


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, partition: str | None = None, block: int | None = None) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k nearest of each query, itself left out; within its partition if one is named. What has no distance (a vector missing, of another length, with gaps) comes last.

    Every query is compared with every vector, a block of queries with a slice of the vectors at a time, as matrices; a pair of these leaves its nearest alone. block: queries of a block, as many as `BLOCK_MB` has if not given."""
    return nearest(vectors, queries, k, partition, block)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, partition: str | None = None, block: int | None = None, among: Callable | None = None) -> DataFrame:
    """As `knn`; among: what tells, of two matrices of queries and vectors, the pairs (rows of queries from, to -> row of each, vector of each) that are compared; all if not given."""
    on = lambda rows, ident, vector: rows.select(ident, F.col(vector).alias("_x"), (F.col(partition) if partition else F.lit(0)).alias("_p")).where(F.col("_p").isNotNull())
    v, q = on(vectors, "vec_id", "embedding"), on(queries, "query_id", "vector")
    # both sizes follow the number of a partition's vectors and queries
    wide = F.greatest(F.max(F.size("_x")), F.lit(1))
    held = v.groupBy("_p").agg(F.count("*").alias("_n"), wide.alias("_w"))
    asked = q.groupBy("_p").agg(F.count("*").alias("_m"))
    room = lambda mb: F.greatest(F.lit(1), F.floor(F.lit(mb * 250_000) / F.col("_w")))
    blocks, slices = F.ceil(F.col("_m") / (F.lit(block) if block else room(BLOCK_MB))), F.ceil(F.col("_n") / room(SLICE_MB))
    sizes = held.join(asked, "_p").select("_p", blocks.cast("int").alias("_blocks"), F.greatest(slices, F.least(F.ceil(F.col("_n") / 4096), F.lit(64))).cast("int").alias("_slices"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda ident, n: F.pmod(F.xxhash64(ident), F.col(n)).cast("int")
    key = ["_p", "_block", "_slice"]
    left = v.join(sizes, "_p").select(*key[:1], each("_blocks").alias("_block"), dealt("vec_id", "_slices").alias("_slice"), "vec_id", "_x")
    right = q.join(sizes, "_p").select(*key[:1], dealt("query_id", "_blocks").alias("_block"), each("_slices").alias("_slice"), "query_id", "_x")
    schema = T.StructType([right.schema["query_id"], left.schema["vec_id"], T.StructField("distance", T.DoubleType())])

    def run(some: pa.Table, asking: pa.Table) -> pa.Table:
        out = _nearest(some.column("vec_id"), some.column("_x"), asking.column("query_id"), asking.column("_x"), k, among)
        return pa.table(out, names=["query_id", "vec_id", "distance"])

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema).withColumn("distance", F.round("distance", 6))
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, filled up with zeros, and their lengths; -1 of one that isn't there or has gaps."""
    lists = column.combine_chunks()
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), -1), dtype=np.int64)
    values = lists.flatten()
    if len(lengths) and values.null_count == 0 and (lengths == lengths[0]).all() and lengths[0] > 0:
        return np.asarray(values, dtype=float).reshape(len(lengths), -1), lengths
    out = np.zeros((len(lengths), max(1, lengths.max(initial=1))))
    for i, x in enumerate(lists.to_pylist()):
        if x is None or any(e is None for e in x):
            lengths[i] = -1
        else:
            out[i, : len(x)] = x
    return out, lengths


def _nearest(vec_ids: pa.ChunkedArray, vectors: pa.ChunkedArray, query_ids: pa.ChunkedArray, queries: pa.ChunkedArray, k: int, among: Callable | None) -> list[pa.Array]:
    """query, vector and distance of those that may be among the k nearest; by the form of the matrix product first, then exactly, dimension by dimension as in `l2`."""
    (x, own), (y, theirs) = _matrix(vectors), _matrix(queries)
    wide = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (x, y))
    if not len(x) or not len(y):
        return [query_ids.combine_chunks()[:0], vec_ids.combine_chunks()[:0], pa.array([], pa.float64())]
    # ids as numbers in their order, for ties, and those of queries among them, to leave these out
    code = np.unique(np.concatenate([np.asarray(vec_ids), np.asarray(query_ids)]), return_inverse=True)[1]
    order, self_ = code[: len(x)], code[len(x) :]
    with np.errstate(all="ignore"):
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    slack = 1e-11 * (np.max(xx, initial=1, where=np.isfinite(xx)) + np.max(yy, initial=1, where=np.isfinite(yy)))
    pairs = among(y, x) if among else None
    turned, odd = -2 * x.T, not np.isfinite(xx).all() or not np.isfinite(yy).all() or len(np.unique(np.r_[own, theirs])) > 1 or own[0] < 0
    step, far, found = max(1, (1 << 19) // len(x)), 1e300, []
    for a in range(0, len(y), step):
        b = min(len(y), a + step)
        with np.errstate(all="ignore"):
            if pairs is None:
                near = y[a:b] @ turned
                near += xx
                near += yy[a:b, None]
                if odd:
                    near[~np.isfinite(near) | (theirs[a:b, None] != own) | (theirs[a:b, None] < 0)] = far
            else:
                near = np.full((b - a, len(x)), np.inf)
                i, j = pairs(a, b)
                for at in range(0, len(i), 100_000):
                    r, c = i[at : at + 100_000], j[at : at + 100_000]
                    d = xx[c] + yy[a + r] - 2 * np.einsum("ij,ij->i", y[a + r], x[c])
                    near[r, c] = np.where(np.isfinite(d) & (theirs[a + r] == own[c]) & (own[c] >= 0), d, far)
        near[self_[a:b, None] == order[None, :]] = np.inf
        kth = np.partition(near, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(b - a, far)
        # rounding to six digits may make neighbours of those that are a little farther
        most = np.where(kth < far, (np.sqrt(np.maximum(kth + slack, 0)) + 2e-6) ** 2 + slack, far)
        i, j = np.nonzero(near <= most[:, None])
        for at in _cuts(i, 200_000):
            found.append(_exact(x, y, own, theirs, order, i[at] + a, j[at], k))
    i, j, d, none = (np.concatenate(c) for c in zip(*found))
    return [query_ids.combine_chunks().take(pa.array(i)), vec_ids.combine_chunks().take(pa.array(j)), pa.array(d, mask=none)]


def _cuts(rows: np.ndarray, most: int) -> list[slice]:
    """Slices of about so many of the sorted rows, none of which cuts equal ones."""
    ends = np.unique(np.searchsorted(rows, rows[most - 1 :: most], side="right")).tolist() if len(rows) else []
    edges = [0, *ends, len(rows)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if a < b or len(edges) == 2]


def _exact(x: np.ndarray, y: np.ndarray, own: np.ndarray, theirs: np.ndarray, order: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of pairs of rows of y and x, those that may be among the k nearest of their y: row, row, distance, whether there is none. Of equal distances k at most stay."""
    total = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for n in range(x.shape[1]):
            total += (x[j, n] - y[i, n]) ** 2
    d, none = np.sqrt(total), (theirs[i] != own[j]) | (theirs[i] < 0)
    far = np.where(none, 4e300, np.where(np.isnan(d), 3e300, np.where(np.isinf(d), 2e300, d)))
    at = np.lexsort((order[j], far, i))
    i, j, d, none, far = i[at], j[at], d[at], none[at], far[at]
    place = np.arange(len(i))
    new = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, place, 0))
    alike = np.maximum.accumulate(np.where(new | np.r_[True, far[1:] != far[:-1]][: len(i)], place, 0))
    last = far[np.minimum(first + k - 1, len(i) - 1)] if len(i) else far
    last = np.where(i[np.minimum(first + k - 1, len(i) - 1)] == i, last, np.inf) if len(i) else last
    keep = (place - alike < k) & (far <= last + 2e-6)
    return i[keep], j[keep], d[keep], none[keep]


def hybrid(text_hits: DataFrame, vector_hits: DataFrame) -> DataFrame:
    """id, by_text, distance of the union: text first, vector hits add their distance."""
    t = text_hits.select("id", F.lit(True).alias("by_text"))
    v = vector_hits.groupBy("id").agg(F.min("distance").alias("distance"))
    return t.join(v, "id", "full").select("id", F.coalesce("by_text", F.lit(False)).alias("by_text"), "distance")
