"""Whitening, pigeonring near-dedup and the three-way merge against brute force and SQL."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from factgraph.llm import branch_merge, pigeonring, queries, whitening

WORD = r"[^\x20\x09-\x0D]+"
FOLDER = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, component string")


def brute_whitening(rows, most=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted(set(map(tuple, (x for _, x in kept))))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[float(v * n - s) / n for v, s in zip(x, sums)] for x in distinct])
    v = centred.T @ centred / n
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1][:most], parts[:, ::-1][:, :most]
    out = {}
    for i, x in kept:
        z = np.array([float(a * n - s) / n for a, s in zip(x, sums)])
        for j in range(len(values)):
            out[(i, j + 1)] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), float(z @ parts[:, j]) / math.sqrt(values[j]), values[j] / np.trace(v))
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.2, (400, 20)) @ np.diag(np.linspace(0.2, 2, 20))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(5, rows[7][1]), (None, rows[9][1])]
    broken = [(2000, None), (2001, [float("nan")] * 20), (2002, [None, *rows[0][1][1:]]), (2003, [float("-inf"), *rows[0][1][1:]]), (2004, [0.5, 0.5]), (2005, [])]
    got = whitening.whitened(vectors(spark, rows + broken)).collect()
    want = brute_whitening(rows)
    assert len(got) == 16 * len(rows) and len({r.whitened for r in got if r.vec_id == 5}) == 32 and {(r.vec_id, r.component) for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, white, explained = want[(r.vec_id, r.component)]
        if r.vec_id == 5:  # the id of two rows
            continue
        assert (r.n, r.deviation) == (n, deviation) and math.isclose(r.explained, explained, rel_tol=1e-9) and r.identity_error < 1e-9
        s = sign.setdefault(r.component, 1 if abs(r.whitened - white) < abs(r.whitened + white) else -1)
        assert abs(r.whitened - s * white) < 1e-8


def test_whitening_of_few_far_or_no_vectors(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == [] and whitening.whitened(vectors(spark, [(1, None)])).collect() == []
    one = whitening.whitened(vectors(spark, [(1, [0.25, 0.5]), (2, [0.25, 0.5])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whitened(vectors(spark, [(i, [float(i), 1.0, 2.0 * i]) for i in range(10)])).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True} and all(r.identity_error < 1e-9 for r in flat)
    far = whitening.whitened(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])])).collect()
    assert len(far) == 6 and [r.deviation is None for r in sorted(far, key=lambda r: r.vec_id)] == [True] * 4 + [False] * 2


def test_exact_sums_beyond_64_bits(spark):
    x = 2**40 + 12345
    rows = spark.range(1000).selectExpr(f"array({x}L, -{x}L, id) AS x")
    assert whitening.exact_sums(rows, 3) == (1000, [1000 * x, -1000 * x, 499500])
    assert whitening.exact_sums(rows.limit(0), 3)[0] == 0


def brute_print(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    spans = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_pigeonring_components_equal_brute_force(spark):
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(4000)}" for _ in range(2000))
    texts = [base, base.upper().replace("W", "W"), base.replace(" ", "\t\n")]
    for _ in range(60):
        w = base.split()
        for _ in range(rng.randrange(1, 30)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "One", "one", "one two", "É ñ Ä 日本 É ñ Ä", "x" * 100_000, "a b c " * 40_000, *[" ".join(f"v{rng.randrange(500)}" for _ in range(40)) for _ in range(60)]]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, key string")
    got = {r.doc_id: r for r in pigeonring.near_components(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)
    kept = pigeonring.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(prints)))
    assert pigeonring.near_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("ring", [pigeonring.Ring(), pigeonring.Ring(2, 4), pigeonring.Ring(0, 1), pigeonring.Ring(5, 16)])
@pytest.mark.parametrize("tile", [4096, 40])
def test_pigeonring_links_connect_all_within_the_radius(spark, ring, tile):
    rng = random.Random(tile)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(12):  # chains of neighbours at, within and beyond the radius
            for b in rng.sample(range(64), rng.choice([1, ring.radius, ring.radius + 1]) or 1):
                p ^= 1 << b
            prints.add(p)
    hub = rng.getrandbits(64)
    prints |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)} | {0, 2**64 - 1}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "fp long")
    index = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pigeonring.links(nodes, ring, tile).collect():
        a, b = a % 2**64, b % 2**64
        assert bin(a ^ b).count("1") <= ring.radius and a != b
        parent[root(index[a])] = root(index[b])
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= ring.radius:
                assert root(i) == root(j)


def test_pigeonring_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "e f g h i"), (None, None), (None, "")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in pigeonring.near_components(docs).collect()) == [(-1, -1), (-1, -1), (-1, 3), (3, 3), (3, 3)]
    with pytest.raises(ValueError):
        pigeonring.Ring(8, 8)


def brute_merge(rows):
    """Version by version, one row after the other."""
    code = lambda b, i, name: zlib.crc32(f"{b}:{i}:{name}".encode()) % 11
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    mark = lambda c, v: v + "!" if c == 1 else v + "?" if c == 2 else v
    out, fresh = {}, {}
    for i, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        lines, versions = text.split("\n"), {}
        for b, shift in (("L", -1), ("R", -2)):
            k = code(b, i, "row")
            if k in (3, 4):
                fresh.setdefault(shift - i, []).append((lang, source, "!" if k == 3 else "?"))
            if k == 0:
                versions[b] = None
                continue
            cols = [("" if code(b, i, n) == 0 else mark(code(b, i, n), v)) for n, v in (("lang", lang), ("source", source))]
            codes = [code(b, i, str(j)) for j in range(len(lines))]
            versions[b] = (cols, [None if c == 0 else mark(c, v) for c, v in zip(codes, lines)], [{3: "!", 4: "?"}.get(c) for c in codes])
        base = ([lang, source], lines, [None] * len(lines))
        left, right = versions["L"], versions["R"]
        if left is None or right is None:
            other = left or right
            if other is None or other == base:
                out[i] = (None, None, None, 1, 0, 0, 0)
            else:
                out[i] = (lang, source, sha(text), 0, 0, 1, 0)
            continue
        counts, merged = [0, 0, 0, 0], []
        for kind in range(3):
            got = []
            for b, x, y in zip(base[kind], left[kind], right[kind]):
                if x != b and y != b and x != y:
                    counts[3 if kind == 2 else 2 if x is None or y is None else 1] += 1
                    got.append(b)
                else:
                    counts[0] += x != b or y != b
                    got.append(x if x != b else y)
            merged.append(got)
        together = [v for pair in zip(merged[1], merged[2]) for v in pair if v is not None]
        out[i] = (*merged[0], sha("\n".join(together)), *counts)
    for i, values in fresh.items():
        out[i] = (values[0][0], values[0][1], sha(values[0][2]), 1, 0, 0, 0) if len(set(values)) == 1 else (None, None, None, 0, 0, 0, 1)
    return out


def merge_table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, lang string, source string, kind int, version string")


def test_merge_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1500):
        text = "\n".join(rng.choice(["", "a", "b c", "É 日本", "x" * 50]) for _ in range(rng.randrange(1, 12))) if i % 9 else rng.choice([None, "", "\n", "\n\n"])
        rows.append((i, text, rng.choice(["en", "", None]), rng.choice(["s", None, "t"])))
    rows.append((5000, "long line\n" * 20_000, "en", "s"))
    got = {r.doc_id: (r.lang, r.source, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest(), r.n_clean, r.n_edit_edit, r.n_edit_delete, r.n_insert_insert) for r in branch_merge.merged_rows(merge_table(spark, rows)).collect()}
    want = brute_merge(rows)
    assert got == want and sum(v[4] for v in want.values()) and sum(v[5] for v in want.values()) and sum(v[6] for v in want.values())


def test_merge_of_repeated_rows_null_ids_and_none(spark):
    docs = merge_table(spark, [(7, "a\nb", "en", "s")] * 5 + [(8, "a", "en", "s"), (8, "b", None, "s"), (None, "a", "en", None), (None, None, None, None)])
    found = branch_merge.merged_rows(docs).collect()
    assert sum(r.doc_id == 7 for r in found) == 1 and sum(r.doc_id == 8 for r in found) == 2 and sum(r.doc_id is None for r in found) == 2
    assert branch_merge.merged_rows(docs.limit(0)).collect() == []


def test_merge_moves_the_texts_once(spark):
    cells = branch_merge.cells(merge_table(spark, [(1, "a\nb", "en", "s")]))
    plan = branch_merge.merge(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_merge_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = queries.QUERIES["op13_branch_merge"](spark, FOLDER)
    want = con.execute(queries.ORACLES["op13_branch_merge"])
    names = [c[0] for c in want.description]
    assert df.columns == names and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))


def test_random_tokens_of_every_alphabet_are_found():
    from factgraph.llm import secret_scan

    rng = random.Random(6)
    for kind in ("hex", "base32", "base36", "BASE36", "base58", "base62", "base64", "base64url"):
        for n in (20, 32, 48):
            tokens = ["".join(rng.choice(secret_scan.ALPHABETS[kind]) for _ in range(n)) for _ in range(100)]
            assert sum(any(k == 3 or k == 2 for _, k, _ in secret_scan.scan_text(f"value {t} here")[1]) for t in tokens) >= 93, (kind, n)
    plain = ["".join(rng.choice(["system", "value", "order", "patient", "number", "record", "update"]) for _ in range(4)) for _ in range(500)] + ["1234567890" * 3, "123e4567-e89b-12d3-a456-426614174000"]
    assert sum(bool(secret_scan.scan_text(f"see {t} there")[1]) for t in plain) <= 5


def test_discoveries_equal_the_procedure_by_hand():
    """e-values sorted by hand, and the three statistics recomputed character by character."""
    from factgraph.llm import secret_scan

    rng, how = random.Random(9), secret_scan.Battery()
    words = ["international", "configuration", "x" * 30, "aaaabbbbccccddddeeee", "0123456789abcdef" * 2]
    tokens = [rng.choice(words) + rng.choice(words) for _ in range(12)] + ["".join(rng.choice(secret_scan.ALPHABETS["base62"]) for _ in range(n)) for n in (20, 22, 25, 30)]
    spans = [(100 * i, 100 * i + len(t), t) for i, t in enumerate(tokens)]
    tested = []
    for s, e, body, kind in (x for t in spans for x in secret_scan.parts(*t, how.least)):
        alphabet, n = secret_scan.ALPHABETS[kind], len(body)
        x = [alphabet.index(c) for c in body]
        chi = sum((x.count(i) - n / len(alphabet)) ** 2 for i in range(len(alphabet))) * len(alphabet) / n
        z = (chi - (len(alphabet) - 1)) / math.sqrt(2 * (len(alphabet) - 1) * (n - 1) / n)
        p = secret_scan.randomness(body, kind)
        assert math.isclose(p[0], 0.5 * math.erfc(z / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-300)
        runs = 1 + sum((a >= len(alphabet) / 2) != (b >= len(alphabet) / 2) for a, b in zip(x, x[1:]))
        assert runs == 1 + sum((a >= len(alphabet) / 2) ^ (b >= len(alphabet) / 2) for a, b in zip(x, x[1:]))
        tested.append((secret_scan.evidence(body, kind, how) if 3 * min(p) >= how.random_p else -math.inf, s, e))
    best = max((k for k in range(1, len(tested) + 1) if sum(math.exp(min(v, 700)) >= len(tested) / (k * how.fdr) for v, _, _ in tested) >= k), default=0)
    want = sorted((s, e) for v, s, e in sorted(tested, key=lambda t: (-t[0], t[1]))[:best])
    assert sorted(secret_scan.discoveries(spans, how)) == want and len(want) >= 4


def test_headings_in_the_header_of_an_article_stay():
    from factgraph.llm.html_extract import main_text, parse

    page = "<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By me</p><nav><h2>Menu</h2></nav></header><p>Body one two three.</p></article><footer><h3>End</h3></footer>"
    assert main_text(parse(page)) == "Title\nBody one two three."
