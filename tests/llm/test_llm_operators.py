import collections
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factgraph.llm import _text as tx
from factgraph.llm import html_extract, language_id, minhash, mixing, packing, quality_rules, queries, secret_scan, simhash, toxicity, warc

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", "a", "\n\n", "a b c d e f " * 40, "É ñ 日本 " * 30, "x" * 5000]


def table(spark, texts, **more):
    rows = [(i, t, "en", "s" if i % 3 else None, len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")


def prose(rng, n, words=None):
    return " ".join(rng.choice(words or [f"w{i}" for i in range(3000)]) for _ in range(n))


def near_copy(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def brute_classes(texts):
    sets = []
    for t in texts:
        w = re.findall(WORD, t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] == texts[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            if same:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_words_and_windows_stay_within_texts():
    texts = ["a b", "", "  c\td  ", "e"]
    data, offsets = tx.buffers(pa.array(texts))
    s, e, doc = tx.words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == ["a", "b", "c", "d", "e"] and doc.tolist() == [0, 0, 2, 2, 3]
    h, d = tx.window_hashes(tx.span_hashes(data, s, e), doc, 5)
    assert d.tolist() == [0, 2, 3] and len(set(h.tolist())) == 3


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(5)
    base = prose(rng, 150)
    texts = [base] + [near_copy(rng, base, rng.randrange(1, 6)) for _ in range(40)] + [prose(rng, rng.randrange(3, 200)) for _ in range(40)] + [base, None, None, "", "", "one two", "one two"]
    got = {r.doc_id: r.class_id for r in minhash.classes(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = minhash.keep_one(table(spark, texts))
    assert kept.columns == table(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(texts)))


def test_keep_one_tells_classes_apart_by_text(spark):
    rng = random.Random(15)
    a, b, c, d, e = (prose(rng, 100) for _ in range(5))
    rows = [(1, a), (1, b), (1, a), (2, near_copy(rng, b, 1)), (None, c), (None, d), (None, c), (None, e), (7, e), (None, None), (None, None)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter([(1, a), (1, b), (None, c), (None, d), (7, e), (None, None)])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    how = minhash.Banding(bands=100, rows=4)
    ids = np.arange(60, dtype=np.uint64)
    a, b = rng.uniform(0.2, 3, 60), rng.uniform(0.2, 3, 60)
    sig = minhash.dart_signatures(np.r_[ids, ids], np.r_[a, b], np.repeat([0, 1], 60), 2, how)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.08


def test_simhash_edits_and_neighbours(spark):
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (300, 200, 40)] + ODD
    rows = {r.doc_id: r for r in simhash.with_edits(table(spark, texts), rows_per_part=3).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t) // 4
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()
    assert rows[0].near_edited > 0.5 > rows[0].near_next
    assert simhash.with_edits(table(spark, [])).count() == 0


def test_block_tables_find_all_within_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(30)]
    every = base + [b ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(1, 5))) for b in base]
    prints = [f"{x % 2**128:032x}" for x in every]
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(r.query_fingerprint, r.fingerprint, r.distance) for r in simhash.within_radius(df, df, 3).collect()}
    want = {(a, b, d) for a in prints for b in prints if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want


@pytest.mark.parametrize("tile", [4, 20_000])
def test_radius_counts_equal_brute_force(spark, tile):
    rng = random.Random(25)
    base = [rng.getrandbits(128) for _ in range(12)]
    every = [b ^ sum({1 << rng.randrange(128) for _ in range(rng.randrange(0, 4))}) for b in base for _ in range(6)] + [0, 0, 1, 2**128 - 1]
    prints = [f"{x:032x}" for x in every]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    got = {r.fingerprint: r.near for r in simhash.radius_counts(df.where("doc_id % 3 = 0"), df, 3, tile=tile).collect()}
    assert got == {p: sum(0 < apart(p, x) <= 3 for x in prints) for p in prints[::3]}
    near = {r.doc_id: r.near_rows for r in simhash.with_near_rows(df).collect()}
    assert near == {i: sum(apart(p, x) <= 3 for x in prints) - 1 if i % 20 == 0 else None for i, p in enumerate(prints)}
    assert simhash.with_near_rows(df.where("false")).count() == 0


def brute_fingerprint(text):
    """128 signed votes of the three-word shingles' 64-bit hashes, one by one."""
    data, offsets = tx.buffers(pa.array([text]))
    s, e, doc = tx.words(data, offsets)
    counts = collections.Counter(tx.window_hashes(tx.span_hashes(data, s, e), doc, 3)[0].tolist())
    bits = ""
    for lane in range(2):
        mixed = {t: int(tx.mix(np.array([(t + 0x9E3779B97F4A7C15 * (lane + 1)) % 2**64], np.uint64))[0]) for t in counts}
        for b in range(64):
            votes = sum((1 if mixed[t] >> b & 1 else -1) * (1 + math.log(n)) for t, n in counts.items())
            bits += "1" if votes > 1e-6 * sum(1 + math.log(n) for n in counts.values()) else "0"
    return "".join(f"{int(bits[i : i + 8], 2):02x}" for i in range(0, 128, 8))


def test_fingerprints_equal_brute_force():
    rng = random.Random(26)
    texts = [prose(rng, n, [f"v{i}" for i in range(40)]) for n in (1, 2, 3, 50, 400)] + ["", "a b c d " * 30]
    data, offsets = tx.buffers(pa.array(texts))
    got = simhash.fingerprints(data, offsets)
    assert [r.tobytes().hex() for r in got] == [brute_fingerprint(t) for t in texts]
    assert simhash.likeness(got[:1], got[:1])[0] == 1 and simhash.likeness(got[:1], 255 - got[:1])[0] == 0


def test_language_id_learns(spark):
    rng = random.Random(4)
    a, b = ["the", "and", "of", "with"], ["der", "und", "für", "nicht"]
    rows = [(i, prose(rng, 30, a if i % 2 else b), "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame(rows + [(100, None, None), (101, "123 ...", None), (102, "", "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id < 60"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(60, 80)) and [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    nothing = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_letters_beyond_the_basic_plane(spark):
    rows = [(i, "the and of " * 9, "en") for i in range(9)] + [(20, "😀🎉 😀", None), (21, "𝟘𝟙🜁", None), (22, "𐐀𐐨", None), (23, "the 😀 and", None), (24, "the   and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    assert got[20] == got[21] == ("und", 0.0) and got[22][0] == "en" and got[23] == got[24]
    grams = lambda t: [x.tolist() for x in language_id.grams(*tx.buffers(pa.array([t])))[:2]]
    assert grams("𐐀b") == grams("𐐨b") and grams("a😀b") == grams("a b")


def test_quality_counts(spark):
    texts = ["a b c a b c a", "x y\nx y\n\nz", "", None, "#$% a"] + ["the of and to " * 50]
    rows = {r.doc_id: r for r in quality_rules.score(table(spark, texts)).collect()}
    assert (rows[0].n_words, rows[0].word_chars, rows[0].n_repeat_words) == (7, 7, 7)
    assert (rows[1].n_dup_lines, rows[4].n_symbols, rows[3].n_words) == (1, 3, 0)
    assert rows[5].base_failed and not rows[5].kept
    assert quality_rules.keep_rows(table(spark, texts)).columns == table(spark, texts).columns


ENGLISH = """It was a bright day in the spring of the year, and the people of the town went out to see what the river had left on the land. For a long time nobody spoke. At first
the water was as high as a man, but by the end of the week it was back in its bed, and with it went the fear that had been on every face. The mayor said that this was the worst of it, and
that the work was to be done from both sides of the bridge at once. In the evening a few of them met in the old school, and it is from them that we have the story."""


def _ratio(text, rules, r):
    """By the definition, in plain Python."""
    words = re.findall(WORD, text)
    distance = lambda p, q: sum((a * math.log2(2 * a / (a + b)) if a else 0) + b * math.log2(2 * b / (a + b)) for a, b in zip(p, q)) / 2
    n, counts = len(words), collections.Counter(words)
    own = [counts[w] for w in r.common]
    a, b = rules.word_bound(len(own))
    by_word = distance([x / n for x in [*own, n - sum(own)]], r.words) / (a + b / n) if n >= rules.guard_words else 0
    kinds = [sum(f(c) for c in text) for f in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\n\v\f\r")]
    other = sum(ord(c) > 127 for c in text)
    shares = [x / len(text) for x in [*kinds, len(text) - sum(kinds) - other, other]]
    return max(by_word, distance(shares, r.classes) / rules.max_class_distance**2 if len(text) >= rules.guard_chars else 0)


def test_quality_verdicts_equal_brute_force(spark):
    rng = random.Random(20)
    rules, refs = quality_rules.Rules(), quality_rules.REFERENCES
    names = [f"word{i}" for i in range(900)]
    weighted = [w for r, w in enumerate(refs["en"].common) for _ in range(60 // (r + 1))]
    texts = [ENGLISH, ENGLISH.upper(), " ".join(f"{w}###" for w in ENGLISH.split())]
    texts += [" ".join(rng.choice(names) for _ in range(n)) for n in (55, 59, 60, 200)]  # no common word
    texts += [" ".join("a" if rng.random() < 0.3 else rng.choice(names) for _ in range(n)) for n in (90, 300)]  # keyword lists in which one word recurs
    texts += [" ".join(rng.choice(weighted if rng.random() < 0.3 else names) for _ in range(n)) for n in (55, 80, 200, 1000) for _ in range(5)]
    texts += [" ".join(rng.choice(list(refs[k].common) + names[:30]) for _ in range(200)) for k in refs] + [" ".join(f"x{i % 10}" for i in range(50)), *ODD, "y " * 300_000]
    rows = {r.doc_id: r for r in quality_rules.score(table(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = not rows[i].base_failed and min(_ratio(t, rules, r) for r in refs.values()) <= 1
        assert rows[i].kept == want, (i, (t or "")[:80])
    assert rows[0].kept and [rows[i].kept for i in (1, 2, 5, 6, 7, 8)] == [False] * 6
    assert quality_rules.score(table(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = pytest.importorskip("duckdb").connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got, want = queries.QUERIES[name](spark, folder), con.execute(queries.ORACLES[name])
    names = sorted(got.columns)
    order = [[d[0] for d in want.description].index(c) for c in names]
    assert collections.Counter(map(tuple, got.select(*names).collect())) == collections.Counter(tuple(r[i] for i in order) for r in want.fetchall())


def test_secret_spans():
    base, every = secret_scan.scan_text("password: hunter22 and AKIAABCDEFGHIJKL12 " + "0123456789abcdef" * 2)
    assert secret_scan.render(base) == "assign:0:18,access:23:41,hex:42:74" and every[:2] == base[:2]
    assert secret_scan.scan_text(None) == ([], []) and secret_scan.base_spans("password=abc: xyz12345") == []
    rng = random.Random(6)
    alphabet = secret_scan.ALPHABETS["base64"]
    hits = sum(bool(secret_scan.scan_text("key " + "".join(rng.choice(alphabet) for _ in range(44)) + " end")[1]) for _ in range(50))
    assert hits >= 40
    plain = ["/usr/share/lib/python3/dist-packages/some-module", "internationalization-of-2023-reports", "12345678901234567890123456"]
    assert not any(secret_scan.scan_text(t)[1] for t in plain)
    assert secret_scan.redact("a password: hunter22 b", secret_scan.base_spans("a password: hunter22 b")) == "a [SECRET] b"


def test_secrets_behind_names_and_in_paths():
    rng = random.Random(16)
    draw = lambda kind, n: "".join(rng.choice(secret_scan.ALPHABETS[kind]) for _ in range(n))
    for before, after in (("AWS_SECRET_ACCESS_KEY=", ""), ("session=", "=="), ("https://h.example/a?sig=", "&x=1"), ("export MY-KEY=", " end")):
        hits = 0
        for _ in range(50):
            value = draw("base64", 44).lstrip("+/").ljust(44, "x")
            spans = secret_scan.scan_text(before + value + after)[1]
            hits += any((s, e) == (len(before), len(before) + 44 + 2 * (after == "==")) for s, _, e in spans)
        assert hits >= 40, before
    step = [(f"/srv/my-data_dir/{(x := draw('base64', 60).replace('/', 'a').lstrip('+'))}", x) for _ in range(50)]
    assert sum(any(path[s:e] == x for s, _, e in secret_scan.scan_text(path)[1]) for path, x in step) >= 40
    letters = ["".join(rng.choice(secret_scan.ALPHABETS["base64"][:52]) for _ in range(44)) for _ in range(50)]
    assert sum(bool(secret_scan.scan_text("key " + x)[1]) for x in letters) >= 30
    plain = ["internationalizationoforganizations", "getElementsByClassNameOrDefaultValue", "content=/usr/share/some-module/python_packages", "3141592653589793238462643383279"]
    assert not any(secret_scan.scan_text(t)[1] for t in plain)


def test_evidence_against_ordinary_tokens_is_an_e_value():
    """Over all tokens of a length, the chances of an ordinary token sum to 1; so the ratio is 1 on average under it."""
    how = secret_scan.Battery()
    total = 0.0
    for token in itertools.product(secret_scan.ALPHABETS["base64"] + "-_", repeat=2):
        total += math.exp(-secret_scan.evidence("".join(token), "base64", how) - 2 * math.log(64))
    assert total == pytest.approx(1)
    rng = random.Random(23)
    words = "get set user name value internal service account report status data table index merge default class element buffer string path".split()
    make = [lambda n: "".join(w.capitalize() for w in rng.choices(words, k=n)), lambda n: "_".join(rng.choices(words, k=n)), lambda n: "/" + "/".join(rng.choices(words, k=n)) + "/2024"]
    assert sum(bool(secret_scan.scan_text(f"x {f(rng.randrange(4, 8))} y")[1]) for f in make for _ in range(300)) <= 3
    for kind, lengths in {"hex": (20, 28), "base32": (20, 40), "base64": (20, 32, 64), "base64url": (24, 44)}.items():
        for n in lengths:
            hits = sum(any(k == 3 for _, k, _ in secret_scan.scan_text("key " + "".join(rng.choice(secret_scan.ALPHABETS[kind]) for _ in range(n)) + " end")[1]) for _ in range(60))
            assert hits >= 54, (kind, n)


def test_scan_and_redaction_of_tables(spark):
    rng = random.Random(24)
    parts = ["password: hunter22x", "Api_Key = 'ABCDEFGH'", "token=short", "AKIAABCDEFGHIJKL12", "AKIAXY", "0123456789abcdef" * 2 + "0", "deadbeef", "é 日本", "\n", "secret", "some prose,"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(60)] + ["password: hunter22x"] * 2 + [*ODD, "a " * 200_000 + "secret: 0123456789"]
    docs = table(spark, texts).withColumnRenamed("node", "spans")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert len(got) == len(texts) and secret_scan.scan(docs.where("false")).count() == 0
    rules = [(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    hidden = {r.doc_id: r for r in secret_scan.redact_rows(docs).collect()}
    for i, t in enumerate(texts):
        base = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, t or "") if ok(m))
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) <= {*got[i].spans.split(","), ""}
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert hidden[i].spans == "clash" and (hidden[i].text is None) == (t is None) and hidden[i].n_chars == (None if t is None else len(hidden[i].text))
        assert t is None or not any(t[a:b] in hidden[i].text for a, _, b in base if b - a > 11) and (base or hidden[i].text == t)
    assert hidden[0].asDict().keys() == set(docs.columns)


def test_extraction_skips_what_surrounds_the_article(spark):
    page = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><div class="cookie-notice">Cookies</div>
    <article><h1>Head &amp; tail</h1><p>One<br> two&nbsp;three<p>Four <b>five</b></p><form><p>Mail</p></form><aside>Side</aside></article>
    <section id="comments"><article class="comment"><p>Nice and a long long long comment that is longer than the article itself, really.</p></article></section><footer>F</footer>"""
    assert html_extract.main_text(html_extract.parse(page)) == "Head & tail\nOne two three\nFour five"
    pages = [(i, f"http://h.example/{i}", f"<body><div>Shared banner text</div><div><p>Story {i} is told here.</p></div><div>Read more</div>") for i in range(6)] + [(10, None, None), (11, "http://x/", "")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} is told here." for i in range(6)) and got[10] == got[11] == ""


@pytest.mark.parametrize("wrapper", ['div class="site has-sidebar"', 'div class="no-header content"', 'div class="sidebar"', 'div id="search"', 'main class="with-sidebar"'])
def test_wrappers_do_not_take_the_article_away(wrapper):
    name, read = wrapper.split()[0], lambda x: html_extract.main_text(html_extract.parse(x))
    around = f"<body><{wrapper}>{{}}<div class='site-footer'>Imprint</div></{name}>"
    assert read(around.format("<article><p>One</p><figure><figcaption>Caption</figcaption></figure></article><article><p>Second part</p></article>")).split("\n")[:3] == ["One", "Caption", "Second part"]
    assert "A long text of this page" in read(around.format("<p>A long text of this page</p>"))
    comments = "<section id='comments'><article><p>A comment that is much longer than the text of this page is</p></article></section>"
    assert read(f"<body><p>Text</p>{comments}") == "Text" and read(f"<body><article>Text</article>{comments}") == "Text"


@pytest.mark.parametrize("piece", ["<a ", "<", "<!--", "<div class='ad'>", "<div>", "</p><div>", "<a '\">", "<p title=\"", "&#", "&amp", "<script>", "<li><b>", "<div class=ad></p>"])
def test_parser_is_linear(piece):
    page = html_extract.parse("<p>Start</p>" + piece * (1_000_000 // len(piece)))
    began = time.time()
    html_extract.main_text(page)
    took = []
    for n in (100_000, 800_000):
        began = time.time()
        html_extract.parse(piece * (n // len(piece)))
        took.append(time.time() - began)
    assert took[1] < 10 and took[1] < 25 * max(took[0], 0.02)
    assert page.blocks[0].text == "Start"


def test_comments_and_tags_that_never_end():
    read = lambda x: html_extract.main_text(html_extract.parse(x))
    assert read("<p>a</p><!-- gone > <p>b</p>") == "a" and read("a <!-- b") == "a" and read("a <!-- b --> c") == "a c"
    assert read("<p>a</p>b < c <d") == "a\nb < c <d" and read("<p>a<b") == "a<b" and read("a -->") == "a -->"
    assert read("<!-- x --><p>a</p><!--y-->") == "a"


def test_classes_equal_brute_force(spark):
    rng = random.Random(30)
    blocks = ["<div>Banner</div>", "<p>Promo {}</p>", "<ul><li>One</li><li>Two</li></ul>", "<h2>Read more</h2>", "<p>Story {}</p>"]
    pages = [(f"http://h{i % 2}.example/{i}", "".join(b.format(rng.randrange(3)) for b in blocks if rng.random() < 0.8)) for i in range(24)] + [("http://h0.example/x", None), (None, "<p>alone</p>")]
    pages += pages[:5]
    got = collections.defaultdict(set)
    for r in html_extract.equivalence_classes(spark.createDataFrame(pages, "url string, html string")).collect():
        got[r.host].add((r.pages, frozenset(t % 2**64 for t in r.tokens)))
    want = collections.defaultdict(set)
    for host in ("h0.example", "h1.example", ""):
        own = sorted({h or "" for u, h in pages if (u or "http:///").split("/")[2] == host})
        seen = [collections.Counter(html_extract.parse(h).tokens) for h in own]
        vectors = collections.defaultdict(set)
        for t in set().union(*seen):
            vectors[tuple(c[t] for c in seen)].add(t)
        for v, tokens in vectors.items():
            n = sum(x > 0 for x in v)
            if len(own) >= 3 and len(tokens) >= 2 and n >= max(2, 0.5 * len(own)):
                want[host].add((n, frozenset(tokens)))
    assert got == want and want


def test_only_the_template_tells_a_notice_from_the_article(spark):
    pages = [(i, "http://h.example/", f"<article><p>Written for the readers of this paper.</p><p>Text {i} of its own.</p></article>") for i in range(8)]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert all("Written" in html_extract.main_text(html_extract.parse(h)) for _, _, h in pages)
    assert {r.text for r in html_extract.extract(docs).collect()} == {f"Text {i} of its own." for i in range(8)}
    long = [*pages, (90, "http://long.example/", "<article>" + "<p>A long page.</p>" * 60_000 + "</article>"), (91, "http://other.example/", None)]
    more = spark.createDataFrame([(*x, "clash", 1) for x in long], "page_id long, url string, html string, text string, _html int")
    got = {r.page_id: (r.n_chars, r.text) for r in html_extract.extract(more).collect()}
    assert got[90][0] == 60_000 * 13 - 1 and got[91] == (0, "") and got[3][1] == "Text 3 of its own."
    assert html_extract.extract(docs.where("false")).count() == 0


def test_near_copies_on_a_small_host_keep_their_article(spark):
    story = [f"<p>{i} Paragraph one of a story.</p><blockquote>{i} Said once.</blockquote><p>{i} Paragraph two of it.</p>" for i in range(4)]
    frame = "<body><div>Shared banner</div><div>{}</div><footer>End</footer>"
    bodies = [story[0], story[0] + "<p>Printed today</p>", story[1], story[2].replace("blockquote", "h4")]
    pages = [(i, f"http://h.example/{i}", frame.format(b)) for i, b in enumerate(bodies)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    first = "0 Paragraph one of a story.\n0 Said once.\n0 Paragraph two of it."
    assert got[0] == first and got[1] == first + "\nPrinted today" and "Shared banner" not in "".join(got.values())


def test_classes_nest_by_order_and_span():
    frame, promo, across, turned = (html_extract.Class(n, n / 10, t) for n, t in ((10, [1, 2, 9]), (8, [3, 4, 5]), (6, [4, 6]), (5, [8, 7])))
    across.tokens = [10, 6]
    got = html_extract.nest([turned, across, promo, frame], [1, 2, 3, 10, 4, 5, 6, 7, 8, 9])
    assert [(c.pages, own, parent) for c, own, parent in got][:2] == [(10, {1, 2, 9}, -1), (8, {3, 4, 5}, 0)]
    assert all(c is not across for c, _, _ in got)  # overlaps promo without lying in it
    assert [len(own) for c, own, _ in got if c is turned] == [1]  # one of two tokens breaks the order
    assert html_extract._in_order([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])


def test_warc_round_trip(spark):
    pages = [(1, "http://b.example/x", "same"), (2, "http://a.example/", "same"), (3, "http://a.example/", "é"), (4, None, None), (5, "u", ""), (3, "http://a.example/", "é")]
    got = warc.captures(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and [r.url_key for r in got] == sorted(r.url_key for r in got)
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == collections.Counter({(1, "response", None): 1, (2, "revisit", 1): 1, (3, "response", None): 1, (3, "revisit", 3): 1, (4, "response", None): 1, (5, "revisit", 4): 1})
    one = next(r for r in got if r.page_id == 3 and r.record_type == "response")
    assert warc.payload_at(one.file, one.offset, one.length).decode() == "é" and one.payload_digest == warc.digest("é".encode())


def test_loser_tree_merges():
    rng = random.Random(7)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    rest, open_, out = 1.5 * sum(sizes.values()), list(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
            open_.remove(s)
    return out


def test_targets_equal_brute_force_with_ties(spark):
    rng = random.Random(29)
    for sizes in ({"a": 24, "b": 8}, {"a": 30, "b": 10, "c": 20}, {"a": 0, "b": 0}, {None: 7}, {"a": 5, None: 5, "Z": 5}, *[{x: rng.randrange(0, 40) for x in rng.sample(["a", "b", "c", "d", "é", None], 4)} for _ in range(6)]):
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(brute_targets(sizes))


def test_mix_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(0, 400)), rng.choice(["a", "b", "c", "d", None])) for i in range(200)] + [(1000, None, "empty"), (3, "x y", "a"), (3, "x y", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, blocks = mixing.mix(docs, mixing.Mix(rows_per_chunk=20, block=16))
    got = first.collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    want = brute_targets(dict(sizes))
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(7), mixing.Mix(rows_per_chunk=20, block=16))[0].collect()
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in got) == collections.Counter((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(docs.where("false"))[0].count() == 0


def test_shards_carry_the_weights_of_the_mix(spark):
    plan = spark.createDataFrame([("hot", 800_000, 1_200_000.0), ("small", 20_000, 40_000.0), (None, 60_000, 120_000.0), ("none", 0, 0.0)], "source string, source_size long, target double")
    by_shard = collections.defaultdict(collections.Counter)
    words = collections.Counter()
    for r in mixing.slots(plan, mixing.Mix(block=16, shard_slots=4096)).collect():
        by_shard[r.shard][r.source] += 1
        words[r.source] += r.n_words
    assert words == {"hot": 1_200_000, "small": 40_000, None: 120_000} and sorted(by_shard) == list(range(32))
    for counts in by_shard.values():
        for source, want in (("hot", 75_000 / 32), ("small", 2_500 / 32), (None, 7_500 / 32)):
            assert abs(counts[source] - want) < 5 * want**0.5


def test_deal_is_one_multinomial_draw():
    n, levels = 5_000, 3
    shard = mixing.deal(np.arange(n), n, levels, 99)
    counts = np.bincount(shard, minlength=8)
    assert (np.diff(shard) >= 0).all() and counts.sum() == n and ((counts - n / 8) ** 2 / (n / 8)).sum() < 26  # 0.0005 of chi-squared with 7 degrees
    some = np.random.default_rng(1).permutation(n)[:300]
    assert (mixing.deal(some, n, levels, 99) == shard[some]).all()
    assert (mixing.deal(np.arange(5), 5, 0, 1) == 0).all()
    draws = np.array([np.bincount(mixing.deal(np.arange(40), 40, 2, k), minlength=4) for k in range(400)])
    assert abs(draws.mean(0) - 10).max() < 0.6 and abs(draws.var(0) - 7.5).max() < 2


def brute_mix(docs, how):
    """(row, pass) -> sorted word numbers, by loops; docs: (row, source, size, h) in the order of the streams."""
    sizes = collections.Counter()
    for _, source, size, _ in docs:
        sizes[source] += size
    out = collections.defaultdict(list)
    first = {}
    for source, target in brute_targets(dict(sizes)).items():
        if not sizes[source]:
            continue
        words = [(row, k) for row, s, size, _ in docs if s == source for k in range(size)]
        blocks = [words[i : i + how.block] for i in range(0, len(words), how.block)]
        key, left, slot = mixing._key(source, how.seed), math.floor(target), 0
        while left:
            which, j = divmod(slot, len(blocks))
            b = int(mixing._feistel(np.array([j]), len(blocks), key + which * 1000003)[0])
            for row, k in blocks[b][:left]:
                out[row, which].append(k)
            left -= min(left, len(blocks[b]))
            slot += 1
    return {k: sorted(v) for k, v in out.items()}


def test_mixed_rows_equal_brute_force(spark):
    rng = random.Random(27)
    how = mixing.Mix(block=8, rows_per_chunk=10**9, shard_slots=16)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "c", None]), "k", i) for i in range(80)] + [(5, "x y z", "a", "k", 1), (5, "x y z", "a", "k", 1), (900, None, "a", None, 2), (901, "one\ttwo\n three", "b", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row string, place int").coalesce(1)
    numbered = docs.withColumn("r", F.monotonically_increasing_id()).select("r", "source", "text", "doc_id", F.xxhash64("doc_id", "text", F.lit(how.seed)).alias("h")).collect()
    streams = sorted(((r.r, r.source, len(re.findall(WORD, r.text or "")), r.h, r.doc_id) for r in numbered), key=lambda x: (x[3], x[4], x[2]))
    want = collections.Counter()
    for (row, _), words in brute_mix([x[:4] for x in streams], how).items():
        text = numbered[row].text
        spans = [m.span() for m in re.finditer(WORD, text)]
        runs = [[w for _, w in g] for _, g in itertools.groupby(enumerate(words), lambda x: x[1] - x[0])]
        want[numbered[row].doc_id, text if len(words) == len(spans) else "\n".join(text[spans[r[0]][0] : spans[r[-1]][1]] for r in runs)] += 1
    mixed = mixing.mixed_rows(docs, how, length=None)
    assert mixed.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in mixed.collect()) == want
    assert mixing.mixed_rows(docs.where("false"), how, length=None).count() == 0


def test_mixed_rows_come_by_shard(spark):
    rng = random.Random(28)
    docs = spark.createDataFrame([(i, prose(rng, 40), "hot" if i % 4 else "rare", 0) for i in range(800)], "doc_id long, text string, source string, n_chars long")
    got = [(r.source, len(r.text.split())) for r in mixing.mixed_rows(docs, mixing.Mix(block=16, shard_slots=64)).collect()]
    total = sum(n for _, n in got)
    share = sum(n for s, n in got if s == "rare") / total
    for k in range(4):  # any quarter of the rows carries the weights
        part = got[k * len(got) // 4 : (k + 1) * len(got) // 4]
        assert abs(sum(n for s, n in part if s == "rare") / sum(n for _, n in part) - share) < 0.12


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 900)) for _ in range(120)] + ODD
    got = packing.pack(table(spark, texts), with_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 1024
    tok = packing._slow("")
    for i, t in enumerate(texts):
        ids = [x for r in sorted(by_doc[i], key=lambda r: r.piece) for x in r.ids]
        assert ids == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= 1.05 * -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(table(spark, [])).count() == 0


def test_both_tokenizers_agree_on_plain_characters():
    chars = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA0, 0x250), *range(0x2010, 0x2028)]]
    rng = random.Random(10)
    texts = ["".join(rng.choice(chars) for _ in range(60)) for _ in range(300)] + [f"{a}{b}x {a}1{b}" for a in chars[::7] for b in chars[::11]] + ["it's  we'll\n\n  x", "  \n"]
    fast, slow = packing._fast(""), packing._slow("")
    for t in texts:
        assert fast.encode_ordinary(t) == slow.encode(t, add_special_tokens=False).ids, repr(t)
    assert packing.encode("a<|endoftext|>b").tolist() == [*slow.encode("a<|endoftext|>b", add_special_tokens=False).ids, 2]


def _lengths(rng, kind, n):
    return {"uniform": lambda: rng.integers(1, 1025, n), "middle": lambda: rng.integers(300, 701, n), "narrow": lambda: rng.integers(200, 401, n), "few": lambda: rng.choice([190, 270, 340, 410, 520], n)}[kind]()


@pytest.mark.parametrize(("kind", "n"), [("uniform", 3_000), ("uniform", 30_000), ("uniform", 400_000), ("middle", 3_000), ("narrow", 30_000), ("few", 30_000)])
def test_program_needs_no_more_sequences_than_best_fit(kind, n):
    h = np.bincount(_lengths(np.random.default_rng(11), kind, n), minlength=1025)
    plan = packing.solve(h)
    used = np.zeros(1025, int)
    for times, items in plan.configurations:
        assert times > 0 and sum(items) <= 1024
        np.add.at(used, items, times)
    total = sum(times for times, _ in plan.configurations)
    assert (used == h).all() and total == plan.placed + plan.rest
    assert plan.bound <= total <= sum(times for times, _ in packing.best_fit(h))
    assert total <= 1.02 * plan.bound and (kind not in ("narrow", "few") or total <= 1.006 * plan.bound)


def test_small_plans_are_near_the_optimum():
    def optimum(items, capacity):
        best = len(items)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for r in set(rooms):
                if r >= items[i]:
                    rest = list(rooms)
                    rest[rest.index(r)] -= items[i]
                    go(i + 1, rest)
            go(i + 1, [*rooms, capacity - items[i]])

        go(0, [])
        return best

    rng = np.random.default_rng(18)
    over = 0
    for _ in range(30):
        items = sorted(rng.integers(3, 17, 11).tolist(), reverse=True)
        plan = packing.solve(np.bincount(items, minlength=25), rounds=30, phases=4)
        total, want = plan.placed + plan.rest, optimum(items, 24)
        assert plan.bound <= want <= total <= want + 1
        over += total - want
    assert over <= 3
    assert packing.solve(np.zeros(9, int)).configurations == [] and packing.solve(np.bincount([8], minlength=9)).configurations == [(1, [8])]


def test_best_configurations_equal_brute_force():
    rng = np.random.default_rng(19)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 13, 4))
        value = rng.random(len(lengths))
        best, pick = packing.price(lengths, value, 12)
        counts = [c for c in itertools.product(*[range(12 // x + 1) for x in lengths]) if np.dot(c, lengths) <= 12]
        for row, k in zip(packing.configurations(lengths, pick, np.arange(len(lengths)), 12), range(len(lengths))):
            assert row @ lengths <= 12 and row @ value == pytest.approx(max(np.dot(c, value) for c in counts if c[k]))
        assert best[12] == pytest.approx(max(np.dot(c, value) for c in counts))


def test_residue_is_packed_best_fit():
    rng = np.random.default_rng(17)
    for n, lengths in ((60_000, 40), (3_000, 60), (5, 60)):
        h = np.bincount(rng.integers(1, lengths + 1, n), minlength=65)
        bins = collections.defaultdict(list)  # by room, piece by piece
        for x in range(64, 0, -1):
            for _ in range(h[x]):
                room = next((r for r in range(x, 64) if bins[r]), 64)
                own = bins[room].pop() if room < 64 else ()
                bins[room - x].append((*own, x))
        got = packing.best_fit(h)
        used = np.zeros(65, int)
        for times, items in got:
            np.add.at(used, items, times)
        assert (used == h).all() and sum(times for times, _ in got) == sum(map(len, bins.values()))
        assert collections.Counter(64 - sum(items) for times, items in got for _ in range(times)) == collections.Counter({r: len(b) for r, b in bins.items() if b})


def test_gradients_match_differences():
    net = toxicity.Net(hidden=3, word_dim=2, char_dim=2, attention=2, window=5, vocabulary=4)
    m = toxicity.start_model(net, np.arange(3, dtype=np.uint64), np.zeros(3, np.float32))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(12)
    ids, chars = rng.integers(0, 4, (5, 3)), rng.standard_normal((5, 3, 2))
    mask, label = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], float), np.array([1.0, 0.0, 1.0])
    _, g = toxicity.gradients(m, ids, chars, mask, label)
    for k, v in m.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 6)]:
            old = v[at]
            v[at] = old + 1e-2
            up = toxicity.gradients(m, ids, chars, mask, label)[0]
            v[at] = old - 1e-2
            down = toxicity.gradients(m, ids, chars, mask, label)[0]
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-2, abs=3e-3), k


def test_toxicity_learns_words():
    rng = random.Random(13)
    texts = [prose(rng, 80) for _ in range(400)]
    labels = np.array([i % 4 == 0 for i in range(400)], float)
    texts = [t.replace(" ", f" {rng.choice(['grub', 'vile'])} ", 1) if y else t for t, y in zip(texts, labels)]
    m = toxicity.train(texts, labels)
    data, offsets = tx.buffers(pa.array([prose(rng, 200), prose(rng, 100) + " vile " + prose(rng, 100), ""]))
    clean, bad, empty = toxicity.text_scores(m, data, offsets, toxicity._char_table(m.net))
    assert clean < 0.3 < bad and empty == pytest.approx(0.25)


def brute_pipeline(spark, rows):
    """What run() returns for (doc_id, text, source), by loops, without the places: Counter of (doc_id, piece, start, length, crc32)."""
    rules, refs = quality_rules.Rules(), quality_rules.REFERENCES

    def good(text):
        words = re.findall(WORD, text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w, n in collections.Counter(windows).items() if n > 1}
        repeated = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
        return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and min(_ratio(text, rules, r) for r in refs.values()) <= 1

    kept = sorted((r for r in rows if good(r[1])), key=lambda r: r[0])
    classes = brute_classes([r[1] for r in kept])
    kept = [r for i, r in enumerate(kept) if classes[i] == i]
    kept = [(i, secret_scan.redact(t, secret_scan.scan_text(t)[1]), s) for i, t, s in kept]
    how = mixing.Mix()
    hashes = {r.doc_id: r.h for r in spark.createDataFrame(kept, "doc_id long, text string, source string").select("doc_id", F.xxhash64("doc_id", "text", F.lit(how.seed)).alias("h")).collect()}
    texts = {i: t for i, t, _ in kept}
    streams = sorted(((i, s, len(re.findall(WORD, t)), hashes[i]) for i, t, s in kept), key=lambda x: (x[3], x[0]))
    out = collections.Counter()
    for (i, _), words in brute_mix(streams, how).items():
        spans = [m.span() for m in re.finditer(WORD, texts[i])]
        runs = [[w for _, w in g] for _, g in itertools.groupby(enumerate(words), lambda x: x[1] - x[0])]
        text = texts[i] if len(words) == len(spans) else "\n".join(texts[i][spans[r[0]][0] : spans[r[-1]][1]] for r in runs)
        ids = packing._slow("").encode(text, add_special_tokens=False).ids + [2]
        ends = list(range(len(ids), 0, -1024))[::-1]
        for k, (lo, hi) in enumerate(zip([0, *ends], ends)):
            out[i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(14)
    weighted = [w for r, w in enumerate(quality_rules.REFERENCES["en"].common) for _ in range(60 // (r + 1))]
    names = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    text = lambda n: " ".join(rng.choice(weighted if rng.random() < 0.3 else names) for _ in range(n)) + "."
    texts = [text(rng.randrange(60, 900)) for _ in range(30)] + [text(4000)]
    texts += [texts[0], near_copy(rng, texts[1], 1), near_copy(rng, texts[30], 20), texts[2] + " password: hunter22x and", "!!! ### " * 80, " ".join(names[:200]), None, "", "short text"]
    rows = [(i, t, rng.choice(["s0", "s1", "s2", None])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pipeline(spark, rows)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), "")
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)


def test_toxicity_on_tables(spark):
    """Labels without documents and documents without labels, nulls, repeated rows, clashing columns, empty tables, texts that are longer than what fitting reads."""
    rng = random.Random(5)
    net = toxicity.Net(hidden=3, word_dim=2, char_dim=2, attention=2, vocabulary=64, epochs=2, longest=400, slices=4)
    texts = [prose(rng, 30) + (" vile" if i % 2 else "") for i in range(40)] + ODD
    docs = table(spark, texts).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(i, i % 2 if i != 7 else None) for i in range(60)] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, net)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({(r.doc_id, r.score) for r in rows if r.doc_id == 1}) == 1
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs.repartition(3), labels, net)).collect()}
    assert again == {r.doc_id: r.score for r in rows}
    assert toxicity.score(docs.limit(0), model).collect() == []
    untaught = toxicity.score(docs, toxicity.fit(docs.limit(0), labels, net)).collect()
    assert all(0 <= r.score <= 1 for r in untaught)


def test_toxicity_reads_even_slices_of_long_texts(spark):
    net = toxicity.Net(longest=40, slices=4)
    texts = ["short", "x" * 40, "".join(f"{i:03d}" for i in range(100)), None]
    got = [r[0] for r in table(spark, texts).orderBy("doc_id").select(toxicity.learned_text(F.col("text"), net)).collect()]
    t = texts[2]
    assert got == ["short", "x" * 40, " ".join(t[i : i + 10] for i in (0, 96, 193, 290)), None]
