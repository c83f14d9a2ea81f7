"""Canonical text, identities and small renderings. Native expressions where the input is strings; plain Python for arbitrary JSON."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_quoted = json.encoder.encode_basestring
_CONSTANTS = {None: "null", True: "true", False: "false"}

REFERENCE_TOKENS = 15


def json_string(c: Column) -> Column:
    """A string as a JSON literal."""
    as_array = F.to_json(F.array(c))
    return F.substring(as_array, F.lit(2), F.length(as_array) - 2)


def canonical_fact(type_: Column, timestamp: Column, content_json: Column, parents: Column) -> Column:
    """Canonical JSON of a fact without author, amendments, retractions or evidence; content_json is canonical already."""
    ids = F.array_join(F.transform(F.array_sort(F.array_distinct(parents)), json_string), ",")
    return F.concat(F.lit('{"amends":[],"content":'), content_json, F.lit(',"parents":['), ids, F.lit('],"retracts":[],"timestamp":'), json_string(timestamp), F.lit(',"type":'), json_string(type_), F.lit("}"))


def identity(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def show_id(fact_id: Column) -> Column:
    """An identity as it is shown outside."""
    return F.concat(F.lit("sha256:"), fact_id)


def read_id(text: Column) -> Column:
    """The identity in a text, with its prefix or without; null for any other text, capitals included."""
    bare = F.regexp_replace(text, "^sha256:", "")
    return F.when(bare.rlike("^[0-9a-f]{64}$"), bare)


def link_id(a: Column, b: Column, tag: Column, relation: Column, rule: Column) -> Column:
    parts = [F.lit('{"fact_a":'), json_string(a), F.lit(',"fact_b":'), json_string(b), F.lit(',"matched_tag":'), json_string(tag), F.lit(',"relation":'), json_string(relation), F.lit(',"rule_version":'), json_string(rule), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 3).cast("long")


def namespace(tag: Column) -> Column:
    return F.regexp_extract(tag, "^[^:]*:", 0)


def safe_query_word(text: Column) -> Column:
    """The longest word of four ASCII letters or more in lower case, the first of equals; `encounter` if there is none."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), 0)
    ranked = F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"), F.lower(w).alias("w")))
    return F.coalesce(F.array_max(ranked)["w"], F.lit("encounter"))


def note_summary(text: Column, limit: int = 200) -> Column:
    """The first heading line, else the first line that isn't blank, cut to bytes without a broken character."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    heading = F.filter(lines, lambda x: x.startswith("#"))
    line = F.coalesce(F.get(heading, F.lit(0)), F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    return first_bytes(line, limit)


def first_bytes(text: Column, limit: int) -> Column:
    """A text cut to bytes without a broken character."""
    raw = text.cast("binary")
    cuts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring(raw, F.lit(1), F.lit(limit) - k).cast("string")), F.is_valid_utf8)
    return F.when(F.octet_length(raw) <= limit, text).otherwise(F.get(cuts, F.lit(0)))


def three_decimals(x: Column) -> Column:
    """Three decimals, half away from zero, without trailing zeros."""
    size = F.floor(F.abs(x) * 1000 + 0.5)
    exact = F.when(F.abs(x) < 1e12, (size.cast("decimal(19,0)") / 1000).cast("decimal(38,3)")).otherwise(F.abs(x).cast("decimal(38,3)"))
    small = F.regexp_replace(exact.cast("string"), r"\.?0+$", "")
    return F.concat(F.when((x < 0) & (size > 0), "-").otherwise(""), F.when(size == 0, "0").otherwise(small))


def _plain_number(text: Column) -> Column:
    """A number as ECMAScript prints it, from its JSON text, as `_number` does."""
    shown = text.cast("double").cast("string")
    part = lambda i: F.regexp_extract(shown, r"^(-?)([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$", i)
    both = F.concat(part(2), part(3))
    led = F.regexp_replace(both, "^0+", "")
    digits = F.regexp_replace(led, "0+$", "")
    n = F.length(digits)
    point = F.length(part(2)) + F.coalesce(F.when(part(4) != "", part(4)).cast("int"), F.lit(0)) - (F.length(both) - F.length(led))
    whole = F.concat(digits, F.repeat(F.lit("0"), point - n))
    split = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    power = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(point > 0, "e+").otherwise("e-"), F.abs(point - 1).cast("string"))
    body = F.when((n <= point) & (point <= 21), whole).when((point > 0) & (point <= 21), split).when((point > -6) & (point <= 0), small).otherwise(power)
    return F.when(digits == "", "0").otherwise(F.concat(part(1), body))


def settled(text: Column) -> Column:
    """RFC 8785 canonical JSON from what `to_json` writes of a VARIANT: its keys are in order already; long, small and large numbers are set anew, escapes in lower case."""
    # a control character is never bare in JSON, so that two of them can stand for what could hide a quote
    shut = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\1")), F.lit('\\"'), F.lit("\2"))
    for code in ("000b", "000e", "000f", *[f"001{x}" for x in "abcdef"]):
        shut = F.replace(shut, F.lit("\\u" + code.upper()), F.lit("\\u" + code))
    tokens = F.regexp_extract_all(shut, F.lit('"[^"]*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'), 0)
    anew = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), _plain_number(t)).otherwise(t)), "")
    back = F.replace(F.replace(anew, F.lit("\2"), F.lit('\\"')), F.lit("\1"), F.lit("\\\\"))
    return F.when(text.rlike(r"[0-9.]{16}|[0-9]E|0\.000000|\\u00[01][0-9A-F]"), back).otherwise(text)


def _number(x: float) -> str:
    """A double as ECMAScript prints it, which RFC 8785 asks for."""
    if math.isnan(x) or math.isinf(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, r = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exp = r.partition("e")
    whole, _, frac = mantissa.partition(".")
    frac = "" if frac == "0" else frac
    digits, point = (whole + frac).lstrip("0"), len(whole) + int(exp or 0)
    point -= len(whole + frac) - len((whole + frac).lstrip("0"))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        return sign + digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + "e" + ("+" if e >= 0 else "-") + str(abs(e))


def canonical(value) -> str:
    """RFC 8785 canonical JSON of a decoded value: keys by UTF-16 code units, ECMAScript numbers, shortest escapes."""
    if isinstance(value, str):
        return _quoted(value)
    if value is None or isinstance(value, bool):
        return _CONSTANTS[value]
    if isinstance(value, (int, float)):
        return _number(float(value))
    if isinstance(value, dict):
        # ASCII keys have the same order by UTF-16 units as by code points
        keys = sorted(value) if all(map(str.isascii, value)) else sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join([f"{_quoted(k)}:{canonical(value[k])}" for k in keys]) + "}"
    return "[" + ",".join([canonical(v) for v in value]) + "]"


def fact_identity(fact: dict) -> str:
    """Content hash of a fact: id arrays sorted without repeats; author and evidence only if they are there."""
    body = {"type": fact["type"], "timestamp": fact["timestamp"], "content": fact.get("content", {})}
    body |= {k: sorted(set(fact.get(k) or [])) for k in ("parents", "amends", "retracts")}
    body |= {k: fact[k] for k in ("author", "evidence") if fact.get(k)}
    return hashlib.sha256(canonical(body).encode()).hexdigest()


def strings(value) -> list[str]:
    """Every string value that is not empty, recursively; keys, numbers and booleans are not values of text."""
    if isinstance(value, str):
        return [value] if value else []
    if isinstance(value, dict):
        return [s for v in value.values() for s in strings(v)]
    return [s for v in value for s in strings(v)] if isinstance(value, list) else []


def cut_bytes(text: str, limit: int) -> str:
    return text.encode()[:limit].decode("utf-8", "ignore")


def format_number(x: float) -> str:
    """Three decimals, half away from zero, without trailing zeros."""
    whole = math.floor(abs(x) * 1000 + 0.5) / 1000
    text = f"{math.copysign(whole, x):.3f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text
