"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import branch_merge, html_extract, language_id, minhash, mixing, packing, pigeonring, quality_rules, secret_scan, simhash, toxicity, warc, whitening
from factgraph.llm._spark import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_near_rows(simhash.with_edits(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, ("doc_id", "held_out"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    labels = table(spark, sf_dir, "labels").where(~language_id.held_out(F.col("doc_id")))
    return toxicity.score(docs, toxicity.fit(docs.where(~F.col("held_out")), labels), ("doc_id", "held_out"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonring.near_components(table(spark, sf_dir, "documents"))


def op13_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = branch_merge.merged_rows(table(spark, sf_dir, "documents"))
    return merged.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_mixing, op3_minhash_dedup, op4_simhash, op5_warc, op6_language_id, op7_quality_rules, op8_secret_scan, op9_toxicity, op10_best_fit_packing, op11_whitening, op12_simhash_near_dedup, op13_branch_merge)}


def _quality_sql() -> str:
    rules, refs = quality_rules.Rules(), quality_rules.REFERENCES

    def divergence(shares: list[str], expected: tuple[float, ...]) -> str:
        parts = [f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + {q} * (log2({q}) - log2(({p} + {q}) / 2)))" for p, q in zip(shares, expected)]
        return f"greatest(({' + '.join(parts)}) / 2, 0)"

    n = "greatest(n, 1)::DOUBLE"
    shares = [f"(lo / {n})", f"(up / {n})", f"(di / {n})", f"(sp / {n})", f"((n - lo - up - di - sp - ot) / {n})", f"(ot / {n})"]
    every = sorted({w for r in refs.values() for w in r.common})
    held = ", ".join(f"coalesce(map_extract(hist, '{w}')[1], 0)::DOUBLE AS w{i}" for i, w in enumerate(every))

    def ratio(r: quality_rules.Reference) -> str:
        own = [f"w{every.index(w)}" for w in r.common]
        base, noise = rules.word_bound(len(own))
        words = divergence([*[f"({w} / m)" for w in own], f"((m - ({' + '.join(own)})) / m)"], r.words)
        return f"greatest(CASE WHEN len(ws) < {rules.guard_words} THEN 0 ELSE {words} / ({base} + {noise} / m) END, CASE WHEN n < {rules.guard_chars} THEN 0 ELSE {divergence(shares, r.classes)} / {rules.max_class_distance**2} END)"

    best = ", ".join(ratio(r) for r in refs.values())
    gone = lambda c: f"(length(x) - length(regexp_replace(x, '{c}', '', 'g')))"
    word, gap, wide, signs = r"[^\x20\x09-\x0D]", quality_rules.SPACE, r"[^\x00-\x7F]", f"[{quality_rules.SYMBOLS}]"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, length(x) AS n, regexp_extract_all(x, '{word}+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{word}')) AS ls FROM t),
h AS (SELECT rid, list_histogram(ws) AS hist, greatest(len(ws), 1)::DOUBLE AS m FROM w),
p AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT j) AS rep FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM p WHERE (rid, g) IN (SELECT (rid, g) FROM p GROUP BY rid, g HAVING count(*) > 1)) GROUP BY rid),
c AS (SELECT w.*, coalesce(rep, 0) AS rep, len(ls) - len(list_distinct(ls)) AS dup, {gone('[a-z]')} AS lo, {gone('[A-Z]')} AS up, {gone('[0-9]')} AS di, {gone(gap)} AS sp, {gone(wide)} AS ot, {gone(signs)} AS sy, m, {held} FROM w JOIN h USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, len(ws) < {rules.min_words} OR 100 * rep > {rules.max_repeat_percent} * len(ws) AS bad, least({best}) AS best FROM c)
SELECT doc_id, len(ws)::BIGINT AS n_words, (n - sp)::BIGINT AS word_chars, sy::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, bad AS base_failed,
 NOT bad AND best <= 1 AS kept FROM f"""


_WARC_SQL = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x),
b AS (SELECT p.*, first, list_transform(generate_series(0, 3), lambda k: ('0x' || substr(p.x, 10 * k + 1, 10))::BIGINT) AS v FROM p JOIN f USING (x))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

# the checksum bit by bit: each byte enters with the first of its eight steps
_MERGE_SQL = """WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, string_split(text, chr(10)) AS xs FROM d),
e AS (SELECT doc_id, 'row' AS name, '' AS v FROM d UNION ALL SELECT doc_id, 'lang', lang FROM d UNION ALL SELECT doc_id, 'source', source FROM d
 UNION ALL SELECT doc_id, (i - 1)::VARCHAR, xs[i] FROM (SELECT doc_id, xs, unnest(generate_series(1, len(xs))) AS i FROM s)),
c AS (SELECT doc_id, name, v, b, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(b || ':' || doc_id || ':' || name, ''), lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) % 11 AS k FROM e CROSS JOIN (SELECT unnest(['L', 'R']) AS b)),
p AS (SELECT doc_id, name, any_value(v) AS v, max(k) FILTER (b = 'L') AS x, max(k) FILTER (b = 'R') AS y FROM c GROUP BY doc_id, name),
w AS (SELECT doc_id, x, y FROM p WHERE name = 'row'),
q AS (SELECT doc_id, name, -1 AS pos, 0 AS kind, v AS base, CASE x WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS l, CASE y WHEN 0 THEN '' WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END AS r
  FROM p WHERE name IN ('lang', 'source')
 UNION ALL SELECT doc_id, name, name::INTEGER, 1, v, CASE x WHEN 0 THEN NULL WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END, CASE y WHEN 0 THEN NULL WHEN 1 THEN v || '!' WHEN 2 THEN v || '?' ELSE v END
  FROM p WHERE name NOT IN ('row', 'lang', 'source')
 UNION ALL SELECT doc_id, name, name::INTEGER, 2, NULL, CASE x WHEN 3 THEN '!' WHEN 4 THEN '?' END, CASE y WHEN 3 THEN '!' WHEN 4 THEN '?' END FROM p WHERE name NOT IN ('row', 'lang', 'source') AND (x IN (3, 4) OR y IN (3, 4))),
m AS (SELECT *, l IS DISTINCT FROM base AS dl, r IS DISTINCT FROM base AS dr, l IS DISTINCT FROM base AND r IS DISTINCT FROM base AND l IS DISTINCT FROM r AS clash FROM q),
n AS (SELECT *, CASE WHEN clash THEN base WHEN dl THEN l ELSE r END AS v FROM m),
g AS (SELECT doc_id, bool_or(dl) AS dl, bool_or(dr) AS dr, count(*) FILTER ((dl OR dr) AND NOT clash) AS clean, count(*) FILTER (clash AND kind < 2 AND l IS NOT NULL AND r IS NOT NULL) AS ee,
 count(*) FILTER (clash AND kind = 1 AND (l IS NULL OR r IS NULL)) AS ed, count(*) FILTER (clash AND kind = 2) AS ii, max(v) FILTER (name = 'lang') AS lang, max(v) FILTER (name = 'source') AS source,
 coalesce(string_agg(v, chr(10) ORDER BY pos, kind) FILTER (kind > 0 AND v IS NOT NULL), '') AS text FROM n GROUP BY doc_id),
f AS (SELECT d.doc_id, d.lang AS bl, d.source AS bs, d.text AS bt, g.* EXCLUDE (doc_id), x = 0 OR y = 0 AS gone, (x = 0 AND y <> 0 AND dr) OR (y = 0 AND x <> 0 AND dl) AS kept FROM d JOIN g USING (doc_id) JOIN w USING (doc_id)),
a AS (SELECT -1 - doc_id AS doc_id, 'L' AS b, lang, source, CASE x WHEN 3 THEN '!' ELSE '?' END AS text FROM d JOIN w USING (doc_id) WHERE x IN (3, 4)
 UNION ALL SELECT -2 - doc_id, 'R', lang, source, CASE y WHEN 3 THEN '!' ELSE '?' END FROM d JOIN w USING (doc_id) WHERE y IN (3, 4)),
h AS (SELECT doc_id, count(DISTINCT (lang, source, text)) = 1 AS one, min(lang) AS lang, min(source) AS source, min(text) AS text FROM a GROUP BY doc_id)
SELECT doc_id, CASE WHEN kept THEN bl WHEN NOT gone THEN lang END AS lang, CASE WHEN kept THEN bs WHEN NOT gone THEN source END AS source, CASE WHEN kept THEN sha256(bt) WHEN NOT gone THEN sha256(text) END AS text_sha256,
 CASE WHEN gone THEN (NOT kept)::BIGINT ELSE clean END AS n_clean, CASE WHEN gone THEN 0 ELSE ee END AS n_edit_edit, CASE WHEN gone THEN kept::BIGINT ELSE ed END AS n_edit_delete, CASE WHEN gone THEN 0 ELSE ii END AS n_insert_insert FROM f
UNION ALL SELECT doc_id, CASE WHEN one THEN lang END, CASE WHEN one THEN source END, CASE WHEN one THEN sha256(text) END, one::BIGINT, 0, 0, (NOT one)::BIGINT FROM h"""

ORACLES: dict[str, str] = {"op5_warc": _WARC_SQL, "op7_quality_rules": _quality_sql(), "op13_branch_merge": _MERGE_SQL}
