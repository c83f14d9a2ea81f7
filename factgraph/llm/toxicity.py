"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

Words are runs of letters and digits in lower case. A word's input is the embedding of its vocabulary entry (learned; one entry for all unknown words) next to
a fixed hashed embedding of its byte trigrams, so that unknown and altered words still differ. The network reads windows of `window` words,
overlapping by half; every window of a text is scored, and the text's score is that of its worst window. Training is multiple-instance: the
window that scores highest carries its text's label. Gradients are written out by hand; Adam updates them.

Fitting draws at most `most` labelled rows by a hash of their id, and of a text of over `longest` characters as many in `slices` even slices, its first and last words included; this bounds
the driver's memory and work. A toxic passage between the slices is not learned from; scoring reads all of every text.
Everything else covers all data. Cases: a text without words scores the share of label 1 in the sample (0 if nothing was learned);
repeated rows are scored each on its own; null labels are not used; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm import _text as tx

F32 = np.float32


@dataclass(frozen=True)
class Net:
    hidden: int = 12
    word_dim: int = 8
    char_dim: int = 16
    attention: int = 12
    window: int = 64
    vocabulary: int = 8192
    char_buckets: int = 4096
    epochs: int = 10
    batch: int = 64
    rate: float = 0.01
    most: int = 4000
    longest: int = 20_000
    slices: int = 8
    seed: int = 3

    @property
    def stride(self) -> int:
        return self.window // 2


_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a batch: index into the distinct ones, text of each word; distinct: hash and character input."""

    index: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    chars: np.ndarray


def _char_table(net: Net) -> np.ndarray:
    return np.random.default_rng(net.seed).choice(np.array([-1, 1], F32), (net.char_buckets, net.char_dim)).astype(F32)


def read_words(data: np.ndarray, offsets: np.ndarray, net: Net, table: np.ndarray) -> Words:
    low = _LOWER[data]
    starts, ends, doc = tx.words(low, offsets, _GAPS)
    hashes = tx.span_hashes(low, starts, ends)
    fresh, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    s, n = starts[first], (ends - starts)[first]
    owner = np.repeat(np.arange(len(s)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    b = low[s[owner] + place].astype(np.uint32) if len(owner) else np.zeros(0, np.uint32)
    before = np.where(place > 0, np.r_[np.zeros(1, np.uint32), b[:-1]] if len(b) else b, 0)
    after = np.where(place < n[owner] - 1, np.r_[b[1:], np.zeros(1, np.uint32)] if len(b) else b, 0)
    h = (before * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (after * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = ((h ^ (h >> np.uint32(13))) % np.uint32(net.char_buckets)).astype(np.int64)
    chars = np.add.reduceat(table[h], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None].astype(F32) if len(s) else np.zeros((0, net.char_dim), F32)
    return Words(index, doc, fresh, chars.astype(F32) * F32(0.5))


def read_all(data: np.ndarray, offsets: np.ndarray, net: Net, table: np.ndarray, size: int = 500_000) -> Words:
    """As `read_words`, a piece of about `size` bytes at a time, as hashing takes many bytes of memory for each byte of text."""
    parts = [(lo, read_words(*tx.cut(data, offsets, lo, hi), net, table)) for lo, hi in tx.pieces(offsets, size)]
    if not parts:
        return read_words(data, offsets, net, table)
    hashes, first, back = np.unique(np.concatenate([w.hashes for _, w in parts]), return_index=True, return_inverse=True)
    base = np.cumsum([0, *(len(w.hashes) for _, w in parts)])
    index = np.concatenate([back[b + w.index] for b, (_, w) in zip(base, parts)])
    return Words(index, np.concatenate([w.doc + lo for lo, w in parts]), hashes, np.concatenate([w.chars for _, w in parts])[first])


def windows(doc: np.ndarray, n_docs: int, net: Net) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of every overlapping window; texts without words have none."""
    counts = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(counts) - counts
    many = np.where(counts > 0, np.maximum(1, -(-(counts - net.window) // net.stride) + 1), 0)
    owner = np.repeat(np.arange(n_docs), many)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = first[owner] + step * net.stride
    return start, np.minimum(net.window, first[owner] + counts[owner] - start), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    net: Net
    known: np.ndarray  # sorted hashes of the vocabulary; entry i + 1 of the embedding, 0 is for the rest
    p: dict[str, np.ndarray] = field(default_factory=dict)
    prior: float = 0.0

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of B windows. gates: [2, T, B, 3H] input parts in reading order of each direction; mask [T, B] or None if all are full."""
        p, h_dim = self.p, self.net.hidden
        _, steps, b, _ = gates.shape
        h = np.zeros((2, b, h_dim), F32)
        out = np.empty((2, steps, b, h_dim), F32)
        saved = []
        for t in range(steps):
            inner = h @ p["U"] + p["b_u"][:, None, :]
            rz = _sigmoid(gates[:, t, :, : 2 * h_dim] + inner[:, :, : 2 * h_dim])
            r, z = rz[:, :, :h_dim], rz[:, :, h_dim:]
            n = np.tanh(gates[:, t, :, 2 * h_dim :] + r * inner[:, :, 2 * h_dim :])
            new = n + z * (h - n)
            if mask is not None:
                m = np.stack([mask[t], mask[steps - 1 - t]])[:, :, None]
                new = h + m * (new - h)
            if keep:
                saved.append((h, r, z, n, inner[:, :, 2 * h_dim :]))
            h = new
            out[:, t] = h
        states = np.concatenate([out[0], out[1, ::-1]], 2)  # [T, B, 2H]
        u = np.tanh(states @ p["A"] + p["b_a"])
        scores = u @ p["v"]
        if mask is not None:
            scores = np.where(mask > 0, scores, F32(-1e9))
        alpha = np.exp(scores - scores.max(0))
        alpha /= alpha.sum(0)
        pooled = np.einsum("tb,tbh->bh", alpha, states)
        logit = pooled @ p["w"] + p["b"]
        return logit, (saved, states, u, alpha, pooled)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """[2, ..., 3H] input parts of inputs [..., D]."""
        out = np.empty((2, *x.shape[:-1], 3 * self.net.hidden), np.result_type(x, self.p["W"]))
        for d in range(2):
            np.matmul(x, self.p["W"][d], out=out[d])
            out[d] += self.p["b_w"][d]
        return out


def start_model(net: Net, known: np.ndarray, odds: np.ndarray) -> Model:
    g = np.random.default_rng(net.seed)
    d, h = net.word_dim + net.char_dim, net.hidden
    r = lambda *s, scale: (g.standard_normal(s) * scale).astype(F32)
    embedding = r(len(known) + 1, net.word_dim, scale=0.1)
    embedding[1:, 0] += odds  # a word's log-odds in the sample is where its learning starts
    p = {"E": embedding, "W": r(2, d, 3 * h, scale=1 / np.sqrt(d)), "b_w": np.zeros((2, 3 * h), F32), "U": r(2, h, 3 * h, scale=1 / np.sqrt(h)), "b_u": np.zeros((2, 3 * h), F32), "A": r(2 * h, net.attention, scale=1 / np.sqrt(2 * h)), "b_a": np.zeros(net.attention, F32), "v": r(net.attention, scale=0.5), "w": r(2 * h, scale=0.3), "b": np.zeros(1, F32)}
    return Model(net, known, p)


def gradients(m: Model, ids: np.ndarray, chars: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of B windows. ids: [T, B]; chars: [T, B, char_dim]; mask: [T, B]."""
    p, h_dim = m.p, m.net.hidden
    x = np.concatenate([p["E"][ids], chars], 2)
    gates = m.gates(x)
    gates[1] = gates[1][::-1]
    steps, b = ids.shape
    logit, (saved, states, u, alpha, pooled) = m.forward(gates, mask, keep=True)
    prob = _sigmoid(logit)
    loss = float(-(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7)).mean())
    d_logit = ((prob - label) / b).astype(F32)
    g = {"w": pooled.T @ d_logit, "b": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["w"]
    d_alpha = np.einsum("bh,tbh->tb", d_pooled, states)
    d_states = alpha[:, :, None] * d_pooled
    d_scores = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    g["v"] = np.einsum("tb,tba->a", d_scores, u)
    d_u = d_scores[:, :, None] * p["v"] * (1 - u * u)
    g["A"], g["b_a"] = np.einsum("tbh,tba->ha", states, d_u), d_u.sum((0, 1))
    d_states = d_states + d_u @ p["A"].T
    d_out = np.stack([d_states[:, :, :h_dim], d_states[::-1, :, h_dim:]])
    d_gates = np.zeros_like(gates)
    g["U"], g["b_u"] = np.zeros_like(p["U"]), np.zeros_like(p["b_u"])
    d_h = np.zeros((2, b, h_dim), F32)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, inner_n = saved[t]
        d_h = d_h + d_out[:, t]
        k = np.stack([mask[t], mask[steps - 1 - t]])[:, :, None]
        d_new = d_h * k
        d_n = d_new * (1 - z) * (1 - n * n)
        d_z = d_new * (h - n) * z * (1 - z)
        d_r = d_n * inner_n * r * (1 - r)
        d_in = np.concatenate([d_r, d_z, d_n], 2)
        d_inner = np.concatenate([d_r, d_z, d_n * r], 2)
        d_gates[:, t] = d_in
        g["U"] += h.transpose(0, 2, 1) @ d_inner
        g["b_u"] += d_inner.sum(1)
        d_h = d_h * (1 - k) + d_new * z + d_inner @ p["U"].transpose(0, 2, 1)
    d_gates[1] = d_gates[1][::-1].copy()
    g["W"] = np.stack([np.einsum("tbd,tbg->dg", x, d_gates[d]) for d in range(2)])
    g["b_w"] = d_gates.sum((1, 2))
    d_x = d_gates[0] @ p["W"][0].T + d_gates[1] @ p["W"][1].T
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], ids.reshape(-1), d_x[:, :, : m.net.word_dim].reshape(-1, m.net.word_dim))
    return loss, g


def _window_logits(m: Model, words: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of all windows; the input parts are computed once for each distinct word."""
    net = m.net
    gates = m.gates(np.concatenate([m.p["E"][m.ids(words.hashes)], words.chars], 1))  # [2, distinct, 3H]
    out = np.zeros(len(start), F32)
    full = length == net.window
    for group, whole in ((np.flatnonzero(full), True), (np.flatnonzero(~full), False)):
        group = group[np.argsort(length[group], kind="stable")]
        for lo in range(0, len(group), 512):
            own = group[lo : lo + 512]
            size = int(length[own].max())
            t = np.arange(size)[:, None]
            at = words.index[np.minimum(start[own] + t, start[own] + length[own] - 1)]
            mask = None if whole else (t < length[own]).astype(F32)
            out[own] = m.forward(np.stack([gates[0][at], gates[1][at[::-1]]]), mask)[0]
    return out


def text_scores(m: Model, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    if not m.p:
        return np.zeros(n)
    words = read_words(data, offsets, m.net, table)
    start, length, owner = windows(words.doc, n, m.net)
    worst = np.full(n, -np.inf)
    if len(start):
        np.maximum.at(worst, owner, _window_logits(m, words, start, length).astype(float))
    return np.where(np.isinf(worst), m.prior, _sigmoid(worst))


def train(texts: list[str] | pa.ChunkedArray, labels: np.ndarray, net: Net = Net()) -> Model:
    """Fit on whole texts with labels 0 and 1."""
    table = _char_table(net)
    if not len(texts):
        return Model(net, np.zeros(0, np.uint64))
    data, offsets = tx.buffers(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts)
    words = read_all(data, offsets, net, table)
    labels = np.asarray(labels, float)
    n = len(texts)
    # vocabulary: words of two texts or more, the most telling first
    pair = np.unique(words.doc.astype(np.int64) * len(words.hashes) + words.index)
    where, which = pair // max(1, len(words.hashes)), pair % max(1, len(words.hashes))
    df = np.bincount(which, minlength=len(words.hashes))
    bad = np.bincount(which, weights=labels[where], minlength=len(words.hashes))
    good, total, positive = df - bad, max(1.0, n - labels.sum()), max(1.0, labels.sum())
    odds = np.log((bad + 0.5) / (positive + 1)) - np.log((good + 0.5) / (total + 1))
    spread = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    z = np.abs(odds) / spread
    z[df < 2] = -1
    chosen = np.sort(np.argsort(-z, kind="stable")[: net.vocabulary])
    chosen = chosen[z[chosen] >= 0]
    lean = np.where(z[chosen] > 3, np.clip(odds[chosen] / 2, -1.5, 1.5), 0).astype(F32)
    m = start_model(net, words.hashes[chosen], lean)
    m.prior = float(labels.mean())
    ids = m.ids(words.hashes)[words.index]
    start, length, owner = windows(words.doc, n, net)
    g = np.random.default_rng(net.seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    tick = 0
    m.p["b"][0] = np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3))
    for epoch in range(net.epochs):
        if epoch < 2 or epoch % 2 == 0:
            logit = _window_logits(m, words, start, length)
            order = np.lexsort((logit, owner))
            top = order[np.flatnonzero(np.r_[owner[order][1:] != owner[order][:-1], True])] if len(order) else order
        for lo in range(0, len(top), net.batch):
            if lo == 0:
                top = g.permutation(top)
            own = top[lo : lo + net.batch]
            t = np.arange(net.window)[:, None]
            at = np.minimum(start[own] + t, start[own] + length[own] - 1)
            mask = (t < length[own]).astype(F32)
            _, grad = gradients(m, ids[at], words.chars[words.index[at]], mask, labels[owner[own]].astype(F32))
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            tick += 1
            pace = net.rate * (1 - 0.8 * epoch / net.epochs)
            for k, v in grad.items():
                v = v * F32(min(1.0, 1.0 / (norm + 1e-9)))
                a, b = moment[k]
                a += F32(0.1) * (v - a)
                b += F32(0.001) * (v * v - b)
                m.p[k] -= (pace * (a / (1 - 0.9**tick)) / (np.sqrt(b / (1 - 0.999**tick)) + 1e-8)).astype(F32)
    return m


def learned_text(text: Column, net: Net) -> Column:
    """What fitting reads of a text: all of it, or slices that are spread evenly."""
    part = net.longest // net.slices
    gap = (F.char_length(text) - part) / (net.slices - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(net.slices - 1)), lambda i: F.substring(text, (F.floor(i * gap) + 1).cast("int"), F.lit(part)))
    return F.when(F.char_length(text) <= net.longest, text).when(F.char_length(text) > net.longest, F.array_join(cut, " "))


def fit(docs: DataFrame, labels: DataFrame, net: Net = Net()) -> Model:
    """docs: doc_id, text of the rows to learn from; labels: doc_id, toxic. The sample is drawn from the labels, and only its documents are fetched."""
    drawn = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id")
    own = docs.where(F.col("text").isNotNull()).select("doc_id", learned_text(F.col("text"), net).alias("text"))
    # the draw is `most` rows at any size of the table; documents that it doesn't reach are not moved
    rows = own.join(F.broadcast(drawn.limit(net.most)), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("text", "toxic").toArrow()
    return train(rows["text"], rows["toxic"].to_numpy().astype(float), net)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.3) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = _char_table(m.net)
        for batch in batches:
            data, offsets = tx.buffers(batch.column(batch.schema.get_field_index(text)))
            found = np.zeros(batch.num_rows)
            for lo, hi in tx.pieces(offsets, 150_000):
                found[lo:hi] = text_scores(m, *tx.cut(data, offsets, lo, hi), table)
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
