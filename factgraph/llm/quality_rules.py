"""Quality rules: base counts of a text, and its divergence from language references. DataFrame functions only.

Every document's character-class histogram and common-word histogram (a cell for each of a language's common words, one for all other words) are compared with
the reference of each language by the Jensen-Shannon distance (square root of the divergence, base 2). A reference's common words share
`common_share` of all words by Zipf's law, in the order of their ranks. A document passes if one language accepts it on both histograms.

Lengths are guarded in two ways. A histogram of n words over k + 1 cells lies about k / (8 n ln 2) of divergence from its own source by chance alone, so that the bound on the
squared distance of words rises by `word_noise` times that. Below `guard_words` words, or `guard_chars` characters, the word or the class histogram is noise and isn't compared at all.

Cases: a null text counts as empty; a document without words fails the base rules; repeated rows are scored each
on its own; no row is dropped, and other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols, and the white space of all word rules.
SYMBOLS = "#*$%&|<>"
SPACE = r"[\x20\x09-\x0D]"
CLASSES = ("lower", "upper", "digit", "space", "symbol", "other")


@dataclass(frozen=True)
class Reference:
    """Expected shares of the character classes in CLASSES' order, and of the common words among all words; common: the words by falling rank."""

    classes: tuple[float, ...]
    common_share: float
    common: tuple[str, ...]

    @property
    def words(self) -> tuple[float, ...]:
        """Shares of the common words by Zipf's law with an exponent of 0.9, and of all others."""
        ranks = [r**-0.9 for r in range(1, len(self.common) + 1)]
        return (*[self.common_share * r / sum(ranks) for r in ranks], 1 - self.common_share)


#: Shares typical of edited prose, and frequent function words, of each language.
REFERENCES = {
    "en": Reference((0.785, 0.020, 0.005, 0.165, 0.020, 0.005), 0.30, ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "are", "this", "at", "from")),
    "fr": Reference((0.730, 0.020, 0.005, 0.165, 0.020, 0.060), 0.30, ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "par", "qui", "dans", "sur", "pas", "avec", "au")),
    "de": Reference((0.770, 0.040, 0.005, 0.155, 0.020, 0.010), 0.30, ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als")),
    "es": Reference((0.740, 0.020, 0.005, 0.165, 0.020, 0.050), 0.30, ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como")),
}


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    guard_words: int = 60
    guard_chars: int = 200
    max_class_distance: float = 0.25
    max_word_distance: float = 0.2
    word_noise: float = 2.0

    def word_bound(self, words: int) -> tuple[float, float]:
        """(a, b): the squared distance over so many common words may be a + b / n at most."""
        return self.max_word_distance**2, self.word_noise * words / (8 * math.log(2))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda variable is never inlined."""
    return F.transform(F.array(value), body)[0]


def _less(text: Column, pattern: str) -> Column:
    """Code points that a removal of the pattern takes away."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice."""

    def of_hashes(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            spots = F.flatten(F.transform(same, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
            return F.size(F.array_distinct(spots))

        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(ranked, of_sorted))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, of_hashes))


def _divergence(shares: Column, reference: tuple[float, ...]) -> Column:
    """Jensen-Shannon divergence, base 2, of two histograms; the second is constant and without zeros."""
    each = lambda p, q: F.when(p > 0, p * F.log2(p / ((p + q) / 2))).otherwise(0.0) + q * (F.log2(q) - F.log2((p + q) / 2))
    return F.greatest(F.aggregate(F.zip_with(shares, F.array(*[F.lit(q) for q in reference]), each), F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: Rules = Rules(), references: dict[str, Reference] = REFERENCES, text: str = "text") -> DataFrame:
    """The columns in `keep`, the base counts, base_failed and kept."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = sorted({w for r in references.values() for w in r.common})
    words = F.array_remove(F.split(body, f"{SPACE}+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")

    def counts(w: Column) -> Column:
        common = F.filter(w, lambda x: x.isin(every))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            _let(common, lambda c: F.array(*[F.size(c) - F.size(F.array_remove(c, x)) for x in every])).alias("common"),
        )

    def chars(rest: Column) -> Column:
        """rest: the text without a-z."""
        return F.struct(
            F.char_length(rest).alias("rest"),
            _less(rest, "[A-Z]+").alias("upper"),
            _less(rest, "[0-9]+").alias("digit"),
            _less(rest, f"{SPACE}+").alias("space"),
            _less(rest, r"[\x80-\x{10FFFF}]+").alias("other"),
            _less(rest, f"[{SYMBOLS}]+").cast("long").alias("n_symbols"),
        )

    seen = docs.select(
        *[F.col(c) for c in keep],
        F.char_length(body).alias("_n"),
        _let(words, counts).alias("_w"),
        _let(F.regexp_replace(body, "[a-z]+", ""), chars).alias("_c"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, w, c = F.col("_n"), F.col("_w"), F.col("_c")
    out = seen.select(
        *[F.col(x) for x in keep],
        w["n_words"].alias("n_words"),
        (n - c["space"]).cast("long").alias("word_chars"),
        c["n_symbols"].alias("n_symbols"),
        "n_dup_lines",
        w["n_repeat_words"].alias("n_repeat_words"),
        "_n",
        F.array(*[x.cast("double") / F.greatest(n, F.lit(1)) for x in (n - c["rest"], c["upper"], c["digit"], c["space"], c["rest"] - c["upper"] - c["digit"] - c["space"] - c["other"], c["other"])]).alias("_h"),
        w["common"].alias("_s"),
    )
    total = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def ratio(r: Reference) -> Column:
        """Above 1: the language's reference is too far."""
        held = F.array(*[F.col("_s")[every.index(x)].cast("double") for x in r.common])
        rest = total - F.aggregate(held, F.lit(0.0), lambda s, x: s + x)
        base, noise = rules.word_bound(len(r.common))
        words_ = _divergence(F.transform(F.array_append(held, rest), lambda x: x / total), r.words) / (F.lit(base) + F.lit(noise) / total)
        classes = _divergence(F.col("_h"), r.classes) / rules.max_class_distance**2
        return F.greatest(F.when(F.col("n_words") < rules.guard_words, 0.0).otherwise(words_), F.when(F.col("_n") < rules.guard_chars, 0.0).otherwise(classes))

    best = F.array_min(F.array(*[ratio(r) for r in references.values()]))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    names = [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (
        out.select(*names, failed.alias("base_failed"), best.alias("_b"))
        .select(*names, "base_failed", (~F.col("base_failed") & (F.col("_b") <= 1.0)).alias("kept"))
    )


def keep_rows(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows that pass, with the columns of docs.

    A filter would be pushed below the projections, and each mention of a count would count all words again; a generator of one row or none stays above them."""
    own = docs.columns
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("text"))
    passed = score(renamed, ("_row",), rules).select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return passed.select(*[F.col("_row").getField(c).alias(c) for c in own])
