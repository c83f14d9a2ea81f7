"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fit counts n-grams of 1 to 3 code points (letters in lower case, everything else one space) into `buckets` cells per
language; the log-probability matrix, of buckets x languages floats, is broadcast, and texts are scored in batches of
sparse n-gram indices with numpy.

Cases: a text that is null or has no letter is `und` with score 0; so is every text when nothing could be learned.
Ties go to the language that sorts first. Repeated rows are scored each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import _text as tx

BUCKETS, ORDERS, CHUNK = 1 << 15, (1, 2, 3), 400_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point of the basic plane: its lower case, or a space if it is no letter."""
    low, letter = np.full(65536, 32, np.uint32), np.zeros(65536, bool)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            small = c.lower()
            low[i] = ord(small) if len(small) == 1 else i
    return low, letter


_LOW, _LETTER = _tables()


def _lower(point: int) -> int:
    """Of any code point: its lower case, or a space if it is no letter."""
    c = chr(point)
    small = c.lower()
    return 32 if not c.isalpha() else ord(small) if len(small) == 1 else point


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every n-gram in the order of the texts, and whether each text has a letter."""
    points, at = tx.code_points(data, offsets)
    n_docs = len(offsets) - 1
    near = np.minimum(points, 65535)
    letter, c = _LETTER[near], _LOW[near]
    far = np.flatnonzero(points > 65535)
    if len(far):
        distinct, which = np.unique(points[far], return_inverse=True)
        letter[far] = np.array([chr(x).isalpha() for x in distinct.tolist()])[which]
        c[far] = np.array([_lower(x) for x in distinct.tolist()], np.uint32)[which]
    doc = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(at))
    has = np.bincount(doc[letter], minlength=n_docs) > 0
    again = np.zeros(len(c), bool)
    again[1:] = (c[1:] == 32) & (c[:-1] == 32) & (doc[1:] == doc[:-1])
    c, doc = c[~again], doc[~again]
    cells, owners = [], []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        size = len(c) - n + 1
        if size <= 0:
            break
        h = (h[:size] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            ok = doc[:size] == doc[n - 1 :]
            x = h[ok] + np.uint32(n)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            cells.append((x & np.uint32(buckets - 1)).astype(np.int32))
            owners.append(doc[:size][ok])
    if not cells:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), has
    return np.concatenate(cells), np.concatenate(owners), has


@dataclass(frozen=True)
class Model:
    """languages in sort order; logs: float32 [languages, buckets]; prior: float64 [languages]."""

    languages: tuple[str, ...]
    logs: np.ndarray
    prior: np.ndarray


def fit(rows: DataFrame, text: str = "text", label: str = "lang", most: int = 20_000, smoothing: float = 0.5, buckets: int = BUCKETS) -> Model:
    """Learn from labelled rows. At most about `most` rows of each language are used, drawn by a hash of their text;
    that bounds the work of fitting, not what is scored. The counts that reach the driver number languages x buckets at most."""
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return Model((), np.zeros((0, buckets), np.float32), np.zeros(0))
    share = F.lit(1.0)
    for k, n in sizes.items():
        if n > most:
            share = F.when(F.col(label) == k, most / n).otherwise(share)
    drawn = rows.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < share * (1 << 20)) if max(sizes.values()) > most else rows
    names = sorted(sizes)
    index = {k: i for i, k in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), buckets), np.int64)
        for batch in batches:
            which = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = tx.buffers(batch.column(0))
            for lo, hi in tx.pieces(offsets, CHUNK):
                cells, doc, _ = grams(*tx.cut(data, offsets, lo, hi), buckets)
                total += np.bincount(which[lo:hi][doc] * buckets + cells, minlength=total.size).reshape(total.shape)
        lang, cell = np.nonzero(total)
        if len(lang):
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[lang, cell], pa.int64())], names=["l", "b", "n"])

    sums = drawn.select(text, label).mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(names), buckets), smoothing)
    table[sums["l"].to_numpy(), sums["b"].to_numpy()] += sums["n"].to_numpy()
    size = np.array([sizes[k] for k in names], float)
    return Model(tuple(names), np.log(table / table.sum(1, keepdims=True)).astype(np.float32), np.log(size / size.sum()))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns in `keep`, lang_pred and score, the posterior probability of the language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in batches:
            data, offsets = tx.buffers(batch.column(batch.schema.get_field_index(text)))
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            for lo, hi in tx.pieces(offsets, CHUNK) if m.languages else ():
                cells, doc, has = grams(*tx.cut(data, offsets, lo, hi), m.logs.shape[1])
                logs = np.stack([p + np.bincount(doc, weights=row[cells], minlength=hi - lo) for p, row in zip(m.prior, m.logs)])
                top = logs.argmax(0)
                odds = 1 / np.exp(np.maximum(logs - logs.max(0), -700)).sum(0)
                best[lo:hi] = np.where(has, top, len(m.languages))
                score[lo:hi] = np.where(has, odds, 0.0)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(key: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the key as text falls in the fold that is kept from learning; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold
