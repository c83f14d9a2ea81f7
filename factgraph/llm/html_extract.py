"""Main-text extraction by equivalence-class template deduction over the pages of a host.

A page is a sequence of tokens: tags told apart by their path in the page, and text blocks with their path. Tokens of a host that
have the same occurrence vector (how often they occur on each of its pages) form an equivalence class. Vectors are not stored:
each is reduced to a 64-bit sum of hashes of (page, count), which Spark aggregates by host and token, so that a host may hold any share of
all pages. A class is valid if it has at least two tokens and occurs on at least half of the host's distinct pages. On each page the classes
are put in the host's order and nested by support (`nest`): tokens out of order and classes that overlap another without lying in it are no template. Text is
template if its class is on nearly all pages, or, outside of articles, if it has the element around it in its class, so that what a few pages have in
common (near copies of an article) stays. What the template does not cover are slots; the slots of the article are
the result, menus, notices, forms, comments and the like being told by their elements and names (whole ones, and never of what holds the article).

Template sizes are bounded: a page has a bounded number of tokens on average, and each template token is on half of the pages.

Cases: null html is the empty page and gives an empty text; a host with fewer than three distinct pages has no template; copies of a page count once
in the statistics; a null or odd URL is a host of its own, ''. Very long pages are parsed whole. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.llm._spark import materialise

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

#: Elements by their part in a page.
RAW = frozenset("script style noscript template title textarea iframe svg math object canvas".split())
OUTSIDE = frozenset("head nav header footer aside form button select menu dialog fieldset label option audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in a class, id or role that name a part outside the article.
NOISE = frozenset(
    """ad ads adv advert adverts advertisement banner promo promoted sponsor sponsored cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup login register share sharing social sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer
    header masthead topbar comment comments commentlist reply replies respond disqus discussion related recommended recommendations widget widgets pagination pager
    toolbar search skip hidden tags complementary contentinfo form disclaimer""".split()
)
#: Words that beside one of NOISE leave a name what it is (site-footer); any other word makes it another name (has-sidebar).
PLAIN = frozenset("area bar block bottom box button buttons center col column container email feed global group icons inner item items left link links list main outer page panel post posts primary right row secondary section site slot top unit wrap wrapper x".split())
#: Names of readers' texts: such a part is never taken for the article.
TALK = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
_WORD = re.compile(r"[a-z]+")


def _noise(attributes: str) -> frozenset[str]:
    """The words of NOISE in the names that are noise as a whole."""
    found: set[str] = set()
    for m in _NAMES.finditer(attributes):
        for name in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", next(filter(None, m.groups()), "")).lower().split():
            words = set(_WORD.findall(name))
            if words & NOISE and words <= NOISE | PLAIN:
                found |= words & NOISE
    return frozenset(found)


@dataclass
class Block:
    token: int
    text: str
    outside: bool
    main: int  # number of the article or main element it is in, 0 for none
    linked: int  # characters within links
    named: int = -1  # number of the nearest element around it whose name is noise, -1 for none
    element: int = 0  # token of the element around it


@dataclass
class Page:
    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    names: list[frozenset[str]] = field(default_factory=list)  # of the elements named as noise
    outer: list[int] = field(default_factory=list)  # the nearest such element around each of them
    around: dict[int, int] = field(default_factory=dict)  # by article or main element, the nearest named element it is in
    own: set[int] = field(default_factory=set)  # article elements that are themselves named so


def settle(page: Page) -> None:
    """Marks as outside what lies in elements named as noise, but for those that hold the article: where no article or main element lies free of them, those
    around the longest; where there is none at all, those with most of the text that is no link."""
    inner = [b for b in page.blocks if not b.outside]
    sizes: dict[int, int] = {}
    for b in inner:
        if b.main and b.main not in page.own and b.named == page.around[b.main]:
            sizes[b.main] = sizes.get(b.main, 0) + len(b.text)
    talk: list[bool] = []  # whether an element, or one around it, holds readers' texts
    for words, o in zip(page.names, page.outer):
        talk.append(bool(words & TALK) or (o >= 0 and talk[o]))
    held: set[int] = set()
    if not any(page.around[k] < 0 for k in sizes):
        open_ = [k for k in sizes if not talk[page.around[k]]]
        if open_:
            at = page.around[max(open_, key=lambda k: (sizes[k], -k))]
            while at >= 0:
                held.add(at)
                at = page.outer[at]
        elif page.names:
            total, by_name = 0, [0] * len(page.names)
            for b in inner:
                n = max(0, len(b.text) - b.linked)
                total += n
                if b.named >= 0:
                    by_name[b.named] += n
            for i in range(len(by_name) - 1, -1, -1):  # an element comes after those around it
                if page.outer[i] >= 0:
                    by_name[page.outer[i]] += by_name[i]
            held = {i for i, n in enumerate(by_name) if 2 * n > total and not page.names[i] & TALK}
    gone: list[bool] = []
    for i, o in enumerate(page.outer):
        gone.append(i not in held or (o >= 0 and gone[o]))
    for b in inner:
        b.outside = b.named >= 0 and gone[b.named]


def parse(source: str) -> Page:
    """Tokens and text blocks, in one pass. Elements that are never closed end with the next one that closes around them."""
    page = Page()
    stack: list[tuple[str, int, int, int, int, int]] = []  # name, outside (1: in a header of the article alone), main, hash of the path, named, token
    open_: Counter[str] = Counter()  # of the stack, by name
    parts: list[str] = []
    linked, mains, links, at, n = 0, 0, 0, 0, len(source)
    last = source.rfind(">") + 1  # no tag ends beyond

    def top() -> tuple[str, int, int, int, int, int]:
        return stack[-1] if stack else ("", 0, 0, 0, -1, 0)

    def pop() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, outside, main, path, around, element = top()
                token = xxhash.xxh3_64_intdigest(text, path & 0xFFFFFFFFFFFFFFFF)
                page.tokens.append(token)
                page.blocks.append(Block(token, text, outside > 0, main, linked, around, element))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece)

    while True:
        m = _TAG.search(source, at, last)
        if not m:
            end = source.find("<!--", at)
            add(source[at : end if end >= 0 else n])
            break
        add(source[at : m.start()])
        at = m.end()
        if at == last and source.startswith("<!--", m.start()) and not source.startswith("-->", at - 3):
            break  # a comment that is never closed
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closes, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closes else 1
            if name == "br":
                parts.append(" ")
            elif not closes and name == "span" and _noise(attributes):
                page.tokens.append(xxhash.xxh3_64_intdigest("span" + attributes, top()[3]))
            continue
        flush()
        links = 0
        if name in RAW:
            if not closes:
                end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else n
            continue
        if closes:
            if open_[name]:
                while pop() != name:
                    pass
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            pop()
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        _, outside, main, path, around, _ = top()
        path = xxhash.xxh3_64_intdigest(name, path)
        # what names a class of elements is part of the role; numbers in it are not
        named = re.sub(r"\d+", "0", "".join(x or y or z for x, y, z in _NAMES.findall(attributes))) if attributes else ""
        page.tokens.append(element := xxhash.xxh3_64_intdigest(named, path))
        if name in VOID or attributes.endswith("/"):
            continue
        noise = _noise(attributes) if attributes and name not in ("html", "body", "main") else frozenset()
        if noise:
            page.outer.append(around)
            around = len(page.names)
            page.names.append(noise)
        if not main and (name in MAIN or 'role="main"' in attributes):
            mains += 1
            main = mains
            page.around[main] = around
            if noise and name in MAIN:
                page.own.add(main)
        if name in OUTSIDE:
            outside = max(outside, 1 if name == "header" and main else 2)
        elif name in HEADINGS and outside == 1:
            outside = 0  # the article's own heading
        stack.append((name, outside, main, path, around, element))
        open_[name] += 1
    flush()
    settle(page)
    return page


def slots(page: Page, template: frozenset[int] | set[int]) -> list[Block]:
    """The text blocks that the template leaves open."""
    return [b for b in page.blocks if b.token not in template]


def main_text(page: Page, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article's slots, a line each: of all article and main elements, or, where there is none, what is not mostly links."""
    inside = [b for b in slots(page, template) if not b.outside]
    chosen = [b for b in inside if b.main] or [b for b in inside if b.linked <= len(b.text) / 2]
    return "\n".join(b.text for b in chosen)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _counts(rows: DataFrame) -> DataFrame:
    """(host, token, pages, vector, spot: sum of its first places) by task, of (host, page, html); summed by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([_signed(k[1]) for k in keys], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([_signed(v[1]) for v in held.values()], pa.int64()), pa.array([v[2] for v in held.values()], pa.int64())], names=["host", "token", "pages", "vector", "spot"])
            held.clear()
            return batch

        for batch in batches:
            for h, page, source in zip(*[c.to_pylist() for c in batch.columns]):
                seen: dict[int, int] = {}
                spots: dict[int, int] = {0: 0}
                for k, token in enumerate(parse(source or "").tokens):
                    seen[token] = seen.get(token, 0) + 1
                    spots.setdefault(token, k)
                seen[0] = 1  # counts the pages of the host
                for token, n in seen.items():
                    v = held.setdefault((h, token), [0, 0, 0])
                    v[0] += 1
                    v[2] += spots[token]
                    v[1] ^= xxhash.xxh3_64_intdigest(page.to_bytes(8, "little", signed=True) + n.to_bytes(4, "little"))
                if len(held) > 100_000:
                    yield out()
        if held:
            yield out()

    return rows.mapInArrow(run, "host string, token long, pages long, vector long, spot long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def equivalence_classes(pages: DataFrame, size: int = 2, support: float = 0.5, least_pages: int = 3) -> DataFrame:
    """host, vector, pages, share (of the host's pages) and tokens of the valid classes, in the order of their mean first places. pages: url, html; copies of a page count once a host."""
    rows = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("host", F.xxhash64("html").alias("page"), "html")
    counts = _counts(_first_of_copies(rows)).groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("spot").alias("spot"))
    counts = materialise(counts.where(F.col("pages") >= 2), "tokens")
    total = counts.where("token = 0").select(F.col("host").alias("h"), F.col("pages").alias("n"))
    frequent = counts.where("token <> 0").join(total, F.col("host") == F.col("h")).where((F.col("n") >= least_pages) & (F.col("pages") >= support * F.col("n")))
    return frequent.groupBy("host", "vector").agg(F.max("pages").alias("pages"), F.max(F.col("pages") / F.col("n")).alias("share"), F.transform(F.sort_array(F.collect_list(F.struct("spot", "token"))), lambda x: x["token"]).alias("tokens")).where(F.size("tokens") >= size)


def _first_of_copies(rows: DataFrame) -> DataFrame:
    """One row of each (host, page). Only pages that have copies are moved, and their copies are merged before the shuffle."""
    repeated = rows.groupBy("host", "page").count().where("count > 1").select("host", "page")
    if repeated.isEmpty():
        return rows
    held = rows.join(repeated, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])
    return rows.join(repeated, ["host", "page"], "left_anti").unionByName(held)


def _in_order(places: list[int]) -> list[int]:
    """Indices of a longest increasing run of places, gaps allowed."""
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(ends, x)
        ends[k:k + 1], last[k:k + 1] = [x], [i]
        before[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


@dataclass
class Class:
    pages: int
    share: float
    tokens: list[int]  # in the host's order


def nest(classes: list[Class], tokens: list[int]) -> list[tuple[Class, set[int], int]]:
    """(class, its tokens in order, parent) of the classes that nest on a page of these tokens, by falling support.

    The parent is the index of the narrowest class before it in whose span the class lies, -1 for none. Tokens that break the host's order go, and a class
    that overlaps an earlier one without lying in it or around it. The first class is the page's frame and spans it; tokens that repeat on the page have no one place,
    so a class of those lies within the frame alone."""
    order: dict[int, int] = {}
    for k, t in enumerate(tokens):
        order.setdefault(t, k)
    count = Counter(tokens)
    here = [(c, own) for c in classes if (own := [t for t in c.tokens if t in order])]
    here.sort(key=lambda x: (-x[0].pages, count[x[1][0]] > 1, min(order[t] for t in x[1])))
    out: list[tuple[Class, set[int], int]] = []
    spans: list[tuple[int, int]] = []
    for c, own in here:
        places = [order[t] for t in own]
        if count[own[0]] > 1 and out:
            out.append((c, set(own), 0))
            spans.append((-1, -1))
            continue
        kept = _in_order(places)
        lo, hi = (places[kept[0]], places[kept[-1]]) if out else (0, len(tokens))
        if any(a < lo <= b < hi or lo < a <= hi < b for a, b in spans):
            continue
        around = [j for j, (a, b) in enumerate(spans) if a <= lo and hi <= b]
        out.append((c, {own[k] for k in kept}, min(around, key=lambda j: spans[j][1] - spans[j][0], default=-1)))
        spans.append((lo, hi))
    return out


def template_of(page: Page, classes: list[Class], common: float = 0.9, least_pages: int = 3) -> set[int]:
    """The tokens of the texts that the host's nested classes cover on a page: those of a class on `common` of the host's pages, and
    outside of articles those that share a class with their element, on `least_pages` or more."""
    held: dict[int, tuple[Class, set[int]]] = {}
    for c, own, _ in nest(classes, page.tokens):
        held.update((t, (c, own)) for t in own)
    found = set()
    for b in page.blocks:
        if b.token in held:
            c, own = held[b.token]
            if c.share >= common or (not b.main and c.pages >= least_pages and b.element in own):
                found.add(b.token)
    return found


def templates(pages: DataFrame, **limits) -> DataFrame:
    """host and template, its valid classes."""
    return equivalence_classes(pages, **limits).groupBy("host").agg(F.collect_list(F.struct("pages", "share", "tokens")).alias("template"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), salt: int = 16) -> DataFrame:
    """The columns in `keep`, text and n_chars. Templates reach the pages by a join on host and a salt, so that a large host is dealt out."""
    found = materialise(templates(pages), "templates")
    salted = found.select(F.col("host").alias("_host"), "template", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_salt"))
    rows = pages.select(*keep, F.coalesce("html", F.lit("")).alias("_html"), host(F.col("url")).alias("_h"))
    joined = rows.join(salted, (F.col("_h") == F.col("_host")) & (F.pmod(F.xxhash64("_html"), F.lit(salt)).cast("int") == F.col("_salt")), "left").select(*keep, "_html", "_h", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[Class]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                held = batch.column(len(keep) + 2)
                texts = []
                for i, (source, name) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())):
                    if name not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[name] = [Class(c["pages"], c["share"], [t % 2**64 for t in c["tokens"]]) for c in held[i].as_py() or ()]
                    page = parse(source)
                    texts.append(main_text(page, template_of(page, known[name]) if known[name] else frozenset()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return joined.mapInArrow(run, T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
