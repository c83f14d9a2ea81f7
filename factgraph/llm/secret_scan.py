"""Secret scan: three base patterns, and a battery of randomness tests for tokens that no pattern names.

Battery, per token of a text (the sides of an inner "=" apart, and the parts of a path, where no alphabet holds it whole): the encoding is
inferred from the characters (digits, hex, base32, base36, base58, base62, base64: the first alphabet that holds them all, in which a random token of a larger one is a random
draw as well); a chi-squared test
of alphabet uniformity, a runs test about the alphabet's middle and a lag-one serial correlation test must together be
consistent with a random draw. What then speaks against an ordinary token (words, paths, identifiers) of the same length is a likelihood ratio, whose logarithm grows
with length; the Benjamini-Hochberg procedure for such e-values over the tokens of the text controls the share of false discoveries, so that a short token, or one
among many, needs more evidence for each character.

Cases: null counts as the empty text, which has no spans; repeated rows are scanned each on its own; very long texts
are scanned whole. Not tested, whatever their characters: tokens of fewer than `least` (20) characters, and numbers, whose digits are no evidence; an UUID is an identifier and, with its hyphens, no
draw from an alphabet. Offsets are code points, ends exclusive. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The base patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
_HINTS = ("passw", "secret", "token", "apikey", "api_key")

_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What an inner "=" parts: padding stays with the last part.
_SIDE = re.compile(r"[^=]+(?:=+$)?")
_STEP = re.compile(r"[^/]+")
#: Alphabets by encoding, in the order in which they are tried.
_DIGITS, _LOW = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "digits": _DIGITS, "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _LOW.upper() + "234567", "base36": _DIGITS + _LOW, "BASE36": _DIGITS + _LOW.upper(),
    "base58": "".join(c for c in _DIGITS + _LOW.upper() + _LOW if c not in "0OIl"), "base62": _DIGITS + _LOW.upper() + _LOW, "base64": _LOW.upper() + _LOW + _DIGITS + "+/", "base64url": _LOW.upper() + _LOW + _DIGITS + "-_",
}
_RANK = {k: {c: i for i, c in enumerate(a)} for k, a in ALPHABETS.items()}
_SETS = {k: set(a) for k, a in ALPHABETS.items()}


#: Shares of the letters a to z in English text, per mille.
_LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_ORDINARY = {c: (1, math.log(0.1)) for c in "0123456789"} | {c: (3, math.log(0.25)) for c in "+/-_"}
_ORDINARY |= {chr(base + i): (group, math.log(x / sum(_LETTERS))) for base, group in ((97, 0), (65, 2)) for i, x in enumerate(_LETTERS)}


@dataclass(frozen=True)
class Battery:
    """least: shortest token; random_p: a text's token is no random draw if the three tests together (Bonferroni) are less likely than this; fdr: share of false discoveries;
    ordinary_switch: how often the class of character (lower, upper, digit, other) changes from one to the next in ordinary tokens."""

    least: int = 20
    random_p: float = 3e-4
    fdr: float = 0.01
    ordinary_switch: float = 0.25


def _upper(z: float) -> float:
    """Chance of a standard normal above z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> str | None:
    seen = set(token)
    return next((k for k, a in _SETS.items() if seen <= a), None)


def randomness(token: str, kind: str) -> tuple[float, float, float]:
    """p-values, under uniform draws from the alphabet, of the chi-squared, runs and serial-correlation tests."""
    rank, size, n = _RANK[kind], len(ALPHABETS[kind]), len(token)
    x = np.array([rank[c] for c in token], dtype=float)
    counts = np.bincount(x.astype(int), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    chi_z = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    high = x >= size / 2
    a = int(high.sum())
    b = n - a
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * a * b / n
    spread = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    runs_p = 2 * _upper(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    y = x - x.mean()
    power = float((y * y).sum())
    corr = float((y[1:] * y[:-1]).sum()) / power if power else 1.0
    serial_p = 2 * _upper(abs(corr + 1 / n) * math.sqrt(n))
    return _upper(chi_z), min(1.0, runs_p), min(1.0, serial_p)


def evidence(token: str, kind: str, how: Battery) -> float:
    """The logarithm of how much likelier the token is as a uniform draw from its alphabet than as an ordinary token of the same length.

    An ordinary token keeps the class of its characters (lower, upper, digit, other) from one to the next but for a share of `ordinary_switch`, and has English letters within a class. Both
    are distributions over all tokens of a length, so that under the second the ratio is 1 on average (an e-value). Digits alone are an ordinary number, and no evidence."""
    if kind == "digits":
        return 0.0
    stay, leave = math.log(1 - how.ordinary_switch), math.log(how.ordinary_switch / 3)
    ordinary, before = math.log(1 / 4), None
    for c in token:
        group, share = _ORDINARY[c]
        ordinary += share + (0.0 if before is None else stay if group == before else leave)
        before = group
    return -len(token) * math.log(len(ALPHABETS[kind])) - ordinary


def parts(start: int, end: int, token: str, least: int) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, characters without padding, encoding) of what is tested of a token: each side of an inner "=", or, of a side that
    no alphabet holds, the steps of the path."""
    for side in _SIDE.finditer(token):
        body = side[0].rstrip("=").lstrip("-_/+")
        if len(body) < least:
            continue
        at = start + side.start() + side[0].find(body)
        if kind := encoding(body):
            yield at, start + side.end(), body, kind
            continue
        for m in _STEP.finditer(body):
            step = m[0].lstrip("-_+")
            if len(step) >= least and (kind := encoding(step)):
                to = at + m.end() if m.end() < len(body) else start + side.end()
                yield at + m.end() - len(step), to, step, kind


def discoveries(tokens: list[tuple[int, int, str]], how: Battery = Battery()) -> list[tuple[int, int]]:
    """The spans of tokens judged random: those that the battery can't tell from random draws, by the Benjamini-Hochberg procedure for e-values among all tokens tested,
    which holds its share of false discoveries however the tokens depend on each other."""
    found = []
    for start, end, body, kind in (x for t in tokens for x in parts(*t, how.least)):
        passes = 3 * min(randomness(body, kind)) >= how.random_p
        found.append((evidence(body, kind, how) if passes else -math.inf, start, end))
    found.sort(key=lambda x: (-x[0], x[1]))
    passed = max((i for i, (e, _, _) in enumerate(found, 1) if e >= math.log(len(found) / (i * how.fdr))), default=0)
    return [(s, e) for _, s, e in found[:passed]]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of the base patterns, leftmost and non-overlapping within a kind."""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scan_text(text: str | None, how: Battery = Battery()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; a random token that lies within a base span adds nothing."""
    text = text or ""
    base = base_spans(text)
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    more = [(s, 3, e) for s, e in discoveries(tokens, how) if not any(a <= s and e <= b for a, _, b in base)] if tokens else []
    return base, sorted([*base, *more])


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mask: str = "[SECRET]") -> str:
    """The text with each maximal union of spans replaced."""
    out, at, to = [], 0, 0
    for s, _, e in sorted(spans):
        if s >= to:
            out += [text[at:s], mask]
        to = max(to, e)
        at = to
    return "".join([*out, text[at:]]) if spans else text


FOUND = T.StructType([T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("n_random", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def _over(column: str, how: Battery, names: list[str], make: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
                extra = make(texts, [scan_text(x, how) for x in texts])
                kept = [c for c in names if c not in extra]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *extra.values()], names=[*kept, *extra])

    return run


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), how: Battery = Battery(), text: str = "text") -> DataFrame:
    """The columns in `keep` (not named like those of FOUND) and what was found."""

    def columns(texts, found):
        count = lambda k: pa.array([sum(x[1] == k for x in every) for _, every in found], pa.int64())
        return {
            "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "n_random": count(3),
            "base_sha256": pa.array([hashlib.sha256(render(base).encode()).hexdigest() for base, _ in found], pa.string()),
            "spans": pa.array([render(every) for _, every in found], pa.string()),
        }

    own = docs.select(*keep, text) if text not in keep else docs.select(*keep)
    schema = T.StructType([docs.schema[c] for c in keep] + list(FOUND.fields))
    return own.mapInArrow(_over(text, how, list(keep), columns), schema)


def redact_rows(docs: DataFrame, how: Battery = Battery(), text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows, with the spans masked and the length column, if there is one, brought up to date. A null text stays null."""
    names = docs.columns
    length = length if length in names else None

    def columns(texts, found):
        fresh = [x if x is None else redact(x, every) for x, (_, every) in zip(texts, found)]
        out = {text: pa.array(fresh, pa.string())}
        if length:
            out[length] = pa.array([None if x is None else len(x) for x in fresh], pa.int64())
        return out

    fields = [docs.schema[c] if c not in (text, length) else T.StructField(c, T.StringType() if c == text else T.LongType()) for c in names]
    kept = [f for f in fields if f.name not in (text, length)]
    tail = [f for f in (T.StructField(text, T.StringType()), T.StructField(length or "", T.LongType())) if f.name]
    return docs.mapInArrow(_over(text, how, names, columns), T.StructType(kept + tail)).select(*[f"`{c}`" for c in names])
