"""More registered queries, on what the first catalogue leaves out: searches with all their filters, clearance of links, incremental state, runs, rules and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.catalogue import _LINKS, CHILD, CUR, ORACLES, STATUS, TURN, _all_links, _doc_status, _links_of, _state_facts, _tags, register
from factgraph.functions import canon, embed, flatten
from factgraph.operators import activity, clearance, corrections, evalkit, graph, ingest, links, search, state
from factgraph.plans import runs
from factgraph.sources import adapter as src
from factgraph.sources import rules as rulefiles

def _empty() -> Column:
    return F.array().cast("array<string>")


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Items of the orders as facts of four types."""
    kids = src.children(spark, d)
    part = F.split_part("fact_id", F.lit("-"), F.lit(2)).cast("long")
    kinds = F.array(*[F.lit(k) for k in ("fhir_condition", "fhir_medicationrequest", "fhir_observation", "clinical_note")])
    return kids.select("fact_id", "patient_root", "parent_id", F.get(kinds, (part % 4).cast("int")).alias("type"), "ts", F.array_join("tags", " ").alias("text"))


INDEX = CHILD + """, idx AS (SELECT fact_id, patient_root, parent_id, ['fhir_condition', 'fhir_medicationrequest', 'fhir_observation', 'clinical_note'][1 + split_part(fact_id, '-', 2)::INTEGER % 4] AS type, ts, t1||' '||t2||' '||t3 AS text FROM child)"""
_HIT = "contains(lower(text), 'brand#1') AND NOT contains(lower(text), 'promo') OR contains(lower(text), 'standard loinc')"


@register(f"WITH {INDEX} SELECT fact_id FROM idx WHERE {_HIT}")
def q54_query_language(spark: SparkSession, d: str) -> DataFrame:
    """Words, a phrase, AND, OR and NOT in one query."""
    return _index(spark, d).where(search.matches(search.parse_query('Brand#1 NOT promo OR "STANDARD loinc"'))).select("fact_id")


@register(f"WITH {INDEX} SELECT fact_id, type, ts FROM idx WHERE type IN ('fhir_condition', 'clinical_note') AND ts >= '1995-03' AND ts < '1996-11-05'")
def q55_type_and_date(spark: SparkSession, d: str) -> DataFrame:
    return search.filtered(_index(spark, d), ["fhir_condition", "clinical_note"], "1995-03", "1996-11-05").select("fact_id", "type", "ts")


_WANTED = ["risk:Brand#7", "atc:PROMO", "risk:Brand#11"]


@register(f"WITH {CHILD} SELECT fact_id, array_to_string(list_filter(['risk:Brand#7', 'atc:PROMO', 'risk:Brand#11'], lambda x: x IN (t1, t2, t3)), ',') AS matched FROM child WHERE t1 IN ('risk:Brand#7', 'risk:Brand#11') OR t2 = 'atc:PROMO'")
def q56_matched_tags(spark: SparkSession, d: str) -> DataFrame:
    return search.matched_tags(_index(spark, d), _tags(spark, d), _WANTED).select("fact_id", F.array_join("matched_tags", ",").alias("matched"))


@register(f"""WITH {INDEX}, a AS (SELECT type AS query, i.fact_id, i.patient_root FROM idx i JOIN child c USING (fact_id) WHERE t1 = 'risk:Brand#7'), f AS (SELECT query, arg_min(patient_root, fact_id) AS p FROM a GROUP BY 1)
SELECT a.* FROM a JOIN f USING (query) WHERE p = patient_root""")
def q57_first_patient(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of the first anchor's patient, for a query each type."""
    found = search.anchors(_index(spark, d), _tags(spark, d), wanted=["risk:Brand#7"], keep=("type",))
    return search.first_patient(found.select(F.col("type").alias("query"), "fact_id", "patient_root"))


@register(f"""WITH {CHILD}, n(id, distance) AS (SELECT fact_id, length(fact_id)::DOUBLE FROM child WHERE t2 = 'atc:ECONOMY') SELECT fact_id, t1 = 'risk:Brand#7' AS by_text, distance FROM child LEFT JOIN n ON id = fact_id WHERE (t1 = 'risk:Brand#7' OR id IS NOT NULL) AND ts >= '1996'""")
def q58_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors by tag and by nearness, from a date on."""
    near = _tags(spark, d).where("tag = 'atc:ECONOMY'").select("fact_id", F.length("fact_id").cast("double").alias("distance"))
    index, tags = _index(spark, d), _tags(spark, d)
    best = tags.where("tag = 'risk:Brand#7'").select(F.col("fact_id").alias("id"))
    return search.filtered(index, date_from="1996").join(search.hybrid(best, near.select(F.col("fact_id").alias("id"), "distance")), F.col("fact_id") == F.col("id")).select("fact_id", "by_text", "distance")


@register(f"WITH {STATUS} SELECT doc_id FROM st WHERE status IS NULL")
def q59_status_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Facts without a status where others have one: an error for a retrieval."""
    st = _doc_status(spark, d).select(F.col("doc_id").alias("fact_id"), "status")
    return state.status_gaps(st, st.where("status is not null")).select(F.col("fact_id").alias("doc_id"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    """Items as conditions and requests whose content calls them active as a string or as a concept, or doesn't."""
    i = _index(spark, d)
    at = F.pmod(F.split_part("fact_id", F.lit("-"), F.lit(3)).cast("long"), F.lit(4))
    field = F.when(F.col("type") == "fhir_condition", "clinicalStatus").otherwise("status")
    value = F.when(at == 0, '"active"').when(at == 1, '{"coding":[{"code":"active"}]}').when(at == 2, '{"coding":[{"code":"resolved"}]}').otherwise('["active"]')
    return i.select("fact_id", "patient_root", "type", F.concat(F.lit('{"'), field, F.lit('":'), value, F.lit("}")).alias("content"))


_ACTIVE = INDEX + """, ok AS (SELECT fact_id, patient_root, type FROM idx JOIN orders ON parent_id = 'O'||o_orderkey WHERE split_part(fact_id, '-', 3)::BIGINT % 4 < 2 AND o_orderstatus = 'O')"""


def _order_status(spark: SparkSession, d: str) -> DataFrame:
    """fact_id, status and current_id of items: those of finished orders are retracted, those of pending ones replaced by the order."""
    e = src.encounters(spark, d).select(F.col("fact_id").alias("parent_id"), "order_status")
    status = F.when(F.col("order_status") == "F", "retracted").when(F.col("order_status") == "P", "amended").otherwise("active")
    return src.children(spark, d).join(e, "parent_id").select("fact_id", status.alias("status"), F.when(F.col("order_status") == "P", F.col("parent_id")).when(F.col("order_status") == "O", F.col("fact_id")).alias("current_id"))


@register(f"WITH {_ACTIVE} SELECT fact_id, patient_root FROM ok WHERE type = 'fhir_condition'")
def q60_active_conditions(spark: SparkSession, d: str) -> DataFrame:
    return state.active_list(_contents(spark, d), _order_status(spark, d), "conditions")


@register(f"WITH {_ACTIVE} SELECT fact_id, patient_root FROM ok WHERE type = 'fhir_medicationrequest'")
def q61_active_medications(spark: SparkSession, d: str) -> DataFrame:
    return state.active_list(_contents(spark, d), _order_status(spark, d), "medications")


@register(ORACLES["q11_record_state"])
def q62_incremental_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of the facts before a point, and then what the facts after it add, is the state of all."""
    facts = _state_facts(spark, d).withColumn("patient_root", F.regexp_replace("fact_id", "^[A-Z]", ""))
    # one patient holds a fact, what it amends and what is said of them
    facts = facts.withColumn("patient_root", F.floor((F.col("patient_root").cast("long") + 1) / 10).cast("string"))
    before = facts.where(F.col("append_seq") < 10**9 + 400)
    old = state.record_state(before.drop("patient_root"))
    return state.extend_state(old, facts, facts.where(F.col("append_seq") >= 10**9 + 400)).where(F.col("fact_id").startswith("D"))


_ORDER_STATUS = """os AS (SELECT c.fact_id, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'P' THEN c.parent_id ELSE c.fact_id END AS cur FROM child c JOIN orders ON c.parent_id = 'O'||o_orderkey)"""


@register(f"""WITH {_LINKS}, {_ORDER_STATUS} SELECT link_id, least(x.cur, y.cur) AS a, greatest(x.cur, y.cur) AS b FROM lk JOIN os x ON x.fact_id = lk.a JOIN os y ON y.fact_id = lk.b
 WHERE x.cur <> y.cur AND x.cur NOT LIKE '%7' AND y.cur NOT LIKE '%7'""")
def q63_links_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Links between current facts, without those that the viewer may not see."""
    st = _order_status(spark, d)
    hidden = st.where(F.col("current_id").endswith("7")).select(F.col("current_id").alias("fact_id")).distinct()
    return links.renewed(_all_links(spark, d, links.current(st, st, hidden))).select("link_id", "a", "b")


@register(f"""WITH {_LINKS}, it AS (SELECT patient_root AS query, fact_id, row_number() OVER (PARTITION BY patient_root ORDER BY ts, fact_id) AS place FROM child)
SELECT x.query, CASE WHEN x.place <= y.place THEN a ELSE b END AS fact_id, link_id, CASE WHEN x.place <= y.place THEN b ELSE a END AS other FROM lk JOIN it x ON x.fact_id = a JOIN it y ON y.fact_id = b AND x.query = y.query WHERE x.place <= 30 AND y.place <= 30""")
def q64_links_attached(spark: SparkSession, d: str) -> DataFrame:
    """Links between the first thirty items of each patient, at the end that comes first."""
    from pyspark.sql import Window

    items = src.children(spark, d).select(F.col("patient_root").alias("query"), "fact_id", F.row_number().over(Window.partitionBy("patient_root").orderBy("ts", "fact_id")).alias("place")).where("place <= 30")
    return links.at_first(_all_links(spark, d, items, ["query"]))


@register(f"""WITH {_LINKS}, s AS (SELECT min(fact_id) AS fact_id FROM child GROUP BY patient_root) SELECT a AS fact_id, b AS other, link_id FROM lk WHERE a IN (FROM s) UNION ALL SELECT b, a, link_id FROM lk WHERE b IN (FROM s)""")
def q65_links_of_facts(spark: SparkSession, d: str) -> DataFrame:
    """All links of the first fact of each patient."""
    ids = src.children(spark, d).groupBy("patient_root").agg(F.min("fact_id").alias("fact_id"))
    return _links_of(spark, d)(ids).select(F.col("src").alias("fact_id"), F.col("dst").alias("other"), "link_id")


@register(f"WITH {_LINKS}, stored AS (SELECT link_id, CASE WHEN e = 1 THEN 'alert' ELSE CASE s WHEN 0 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END END AS severity FROM lk) SELECT severity, count(*)::BIGINT AS n FROM stored GROUP BY 1")
def q66_link_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Curated links are stored again with another severity."""
    every = _all_links(spark, d)
    return links.upsert(every, every.where("evidence_basis = 'curated_knowledge'").withColumn("severity", F.lit("alert"))).groupBy("severity").agg(F.count("*").alias("n"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    e = src.encounters(spark, d).select("fact_id", "patient_root", F.lit("fhir_encounter").alias("type"), "ts")
    p = src.roots(spark, d).select("fact_id", F.col("fact_id").alias("patient_root"), F.lit("patient_registration").alias("type"), F.lit("1900-01-01").alias("ts"))
    return _index(spark, d).select("fact_id", F.when(F.col("ts") >= "1993", F.col("patient_root")).alias("patient_root"), "type", "ts").unionByName(e).unionByName(p)


TYPED = INDEX + """, typed AS (SELECT fact_id, CASE WHEN ts >= '1993' THEN patient_root END AS patient_root, type, ts FROM idx UNION ALL SELECT 'O'||o_orderkey, 'C'||o_custkey, 'fhir_encounter', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'C'||c_custkey, 'C'||c_custkey, 'patient_registration', '1900-01-01' FROM customer)"""


@register(f"""WITH {TYPED}, g(place, resource, type) AS (VALUES (0, 'encounters', 'fhir_encounter'), (1, 'conditions', 'fhir_condition'), (2, 'medications', 'fhir_medicationrequest'), (3, 'observations', 'fhir_observation'), (4, 'procedures', ''), (5, 'notes', 'clinical_note'), (6, 'reports', ''), (7, 'immunizations', ''))
SELECT place::INTEGER AS place, resource, count(DISTINCT coalesce(patient_root, fact_id))::BIGINT AS patients FROM g LEFT JOIN typed USING (type) GROUP BY ALL""")
def q67_resource_groups(spark: SparkSession, d: str) -> DataFrame:
    """Patients by group of resources; facts of no patient count by their own id."""
    return activity.resource_counts(_typed(spark, d))


@register(f"WITH {TYPED} SELECT DISTINCT coalesce(patient_root, fact_id) AS patient_root FROM typed WHERE type IN ('clinical_note', 'fhir_condition')")
def q68_roots_of_types(spark: SparkSession, d: str) -> DataFrame:
    return activity.roots_of_types(_typed(spark, d), ["clinical_note", "fhir_condition"])


@register(f"""WITH {TYPED}, x AS (SELECT *, length(fact_id) AS q, CASE WHEN type = 'fhir_encounter' AND fact_id LIKE '%3' THEN ts END AS died FROM typed WHERE patient_root IS NOT NULL),
a AS (SELECT patient_root, max(ts) AS last_recorded_at, max(ts) FILTER (type <> 'patient_registration') AS last_clinical_at, max(ts) FILTER (type = 'fhir_encounter') AS last_encounter_at, max(died) AS deceased_at FROM x GROUP BY 1)
SELECT patient_root, last_recorded_at, last_clinical_at, last_encounter_at, greatest(last_encounter_at, last_clinical_at) AS last_visit_at, deceased_at FROM a""")
def q69_activity(spark: SparkSession, d: str) -> DataFrame:
    """Activity of patients from facts of all types; the last time of death that was stated counts."""
    t = _typed(spark, d)
    died = F.when((F.col("type") == "fhir_encounter") & F.col("fact_id").endswith("3"), F.col("ts"))
    return activity.activity(t.select("patient_root", "type", "ts", F.col("ts").alias("recorded_at"), died.alias("deceased_at"), F.regexp_replace("ts", "-", "").cast("long").alias("append_seq")))


@register(f"WITH {INDEX} SELECT parent_id AS fact_id, type, count(*)::BIGINT AS n FROM idx JOIN orders ON parent_id = 'O'||o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL")
def q70_encounter_groups(spark: SparkSession, d: str) -> DataFrame:
    return activity.encounter_groups(_index(spark, d), src.encounters(spark, d).where("order_status <> 'P'"))[0]


@register(f"WITH {INDEX} SELECT fact_id, parent_id FROM idx JOIN orders ON parent_id = 'O'||o_orderkey WHERE o_orderstatus = 'P'")
def q71_orphans(spark: SparkSession, d: str) -> DataFrame:
    return activity.encounter_groups(_index(spark, d), src.encounters(spark, d).where("order_status <> 'P'"))[1].select("fact_id", "parent_id")


@register(f"WITH {INDEX} SELECT patient_root, string_agg(text, chr(10) ORDER BY ts, fact_id, text) AS text FROM idx GROUP BY 1")
def q72_full_record(spark: SparkSession, d: str) -> DataFrame:
    return activity.full_record(_index(spark, d))


@register("""WITH r AS (SELECT 'C'||o_custkey AS patient_root, strftime(o_orderdate, '%Y-%m-%d') AS ts, 'O'||o_orderkey AS fact_id, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(o_orderpriority), '[^a-z0-9]+'), lambda w: w <> ''), 1, 2), ' ') AS query FROM orders),
f AS (SELECT patient_root, query, min({'t': ts, 'f': fact_id}) AS first_at FROM r GROUP BY ALL), n AS (SELECT patient_root, row_number() OVER (PARTITION BY patient_root ORDER BY first_at, query)::INTEGER AS place, query FROM f) SELECT * FROM n WHERE place <= 2""")
def q73_query_sample(spark: SparkSession, d: str) -> DataFrame:
    return activity.sample_queries(src.encounters(spark, d).withColumn("name", F.col("o_orderpriority")), 2)


@register("""SELECT 'C'||o_custkey AS patient_root, max(o_orderkey)::BIGINT AS indexed_upto FROM orders GROUP BY 1""")
def q74_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Last positions as maps, read back, and seeded into a state that knows some of them."""
    o = src.table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("patient_root"), F.col("o_orderkey").cast("long").alias("append_seq"))
    seen = runs.watermarks(o).select(F.explode("upto").alias("patient_root", "indexed_upto"))
    some = o.where("append_seq % 3 = 0").groupBy("patient_root").agg(F.min("append_seq").alias("indexed_upto"))
    return runs.seeded(some, seen)


@register("""SELECT o_custkey::BIGINT AS c, (CASE WHEN max(o_orderkey) % 2 = 0 THEN 2 ELSE 1 END)::INTEGER AS attempts, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'again' ELSE 'first' END AS last_error FROM orders GROUP BY 1 HAVING max(o_orderkey) % 5 <> 0""")
def q75_retries(spark: SparkSession, d: str) -> DataFrame:
    """A second batch over patients that failed once: some are done, some fail again."""
    o = src.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k")).select(F.col("o_custkey").cast("string").alias("patient_root"), "k")
    none = o.limit(0)
    first = runs.attempted(o.limit(0).select("patient_root", F.lit(0).alias("attempts"), F.lit("").alias("last_error")), none, o.select("patient_root", F.lit("first").alias("error")))
    second = runs.attempted(first, o.where("k % 5 = 0"), o.where("k % 5 <> 0 and k % 2 = 0").select("patient_root", F.lit("again").alias("error")))
    return second.select(F.col("patient_root").cast("long").alias("c"), "attempts", "last_error")


@register("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), x AS (SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))), 6) AS distance FROM embeddings, q),
k AS (SELECT * FROM x ORDER BY distance, vec_id::VARCHAR LIMIT 40) SELECT vec_id::VARCHAR AS fact_id, distance FROM k WHERE vec_id % 3 <> 0""")
def q76_vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The forty nearest of one vector, without those that are hidden from the viewer."""
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("fact_id"), F.lit("p").alias("patient_root"), "embedding")
    asked = list(e.where("fact_id = '0'").select("embedding").first()[0])
    return search.vector_search(e, asked, 40, hidden=e.where("cast(fact_id as long) % 3 = 0"))


@register("""SELECT doc_id::VARCHAR AS fact_id, (doc_id % 4 <> 0)::INTEGER AS fresh, 64::INTEGER AS size FROM (SELECT DISTINCT doc_id FROM documents WHERE coalesce(text, '') <> '' OR doc_id % 4 = 0)""")
def q77_embed_queue(spark: SparkSession, d: str) -> DataFrame:
    """Facts without a vector wait for one; draining the queue leaves the vectors that were there."""
    index = src.notes(spark, d).dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("string").alias("fact_id"), F.lit("p").alias("patient_root"), "text")
    had = index.where("cast(fact_id as long) % 4 = 0").select("fact_id", "patient_root", F.array_repeat(F.lit(2.0).cast("float"), 64).alias("embedding"))
    made = embed.drained(embed.queued(index, had), had, embed.hash_embedder(64), 64)
    return made.select("fact_id", (F.col("embedding")[0] != 2).cast("int").alias("fresh"), F.size("embedding").alias("size"))


@register("""WITH f AS (SELECT 'D'||doc_id AS fact_id, doc_id % 7 AS k FROM (SELECT DISTINCT doc_id FROM documents)) SELECT fact_id, CASE k WHEN 1 THEN 'identity' WHEN 2 THEN 'subject' WHEN 3 THEN 'other patient in retracts' WHEN 4 THEN 'author' END AS reason FROM f WHERE k BETWEEN 1 AND 4 UNION ALL SELECT 'E'||substr(fact_id, 2), 'refers to a rejected fact' FROM f WHERE k BETWEEN 1 AND 4""")
def q78_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Planted faults: a wrong id, no subject, another patient's fact, no author; and a fact that refers to each of those, which is rejected with it."""
    docs = src.table(spark, d, "documents").select("doc_id").distinct()
    k = F.col("doc_id") % 7
    me = F.concat(F.lit("D"), "doc_id")
    own = docs.select(me.alias("fact_id"), F.when(k == 2, "retraction").otherwise("note").alias("type"), F.when(k != 4, F.lit("me")).alias("author"), F.when(k.isin(3, 4), F.array(F.lit("r"))).otherwise(_empty()).alias("parents"), F.when(k == 4, F.array(F.lit("r"))).otherwise(_empty()).alias("amends"), F.when(k == 3, F.array(F.lit("x"))).otherwise(_empty()).alias("retracts"), F.lit("p").alias("patient_root"), F.when(k == 1, "?").otherwise(me).alias("computed_id"))
    after = docs.select(F.concat(F.lit("E"), "doc_id").alias("fact_id"), F.lit("note").alias("type"), F.lit("me").alias("author"), F.array(me).alias("parents"), _empty().alias("amends"), _empty().alias("retracts"), F.lit("p").alias("patient_root"), F.concat(F.lit("E"), "doc_id").alias("computed_id"))
    known = spark.createDataFrame([("r", "p"), ("x", "q")], "fact_id string, patient_root string")
    return corrections.rejected(own.unionByName(after), known)


@register("""SELECT 'R'||l_partkey AS fact_id, CASE WHEN count(DISTINCT o_custkey) = 1 THEN 'C'||min(o_custkey) END AS patient_root FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey UNION ALL SELECT 'C'||c_custkey, 'C'||c_custkey FROM customer""")
def q79_resolved_roots(spark: SparkSession, d: str) -> DataFrame:
    """The library's resolution: registrations are their own patient, reports on a part belong to the patient whom all their orders share."""
    li, e = src.table(spark, d, "lineitem"), src.encounters(spark, d).select("fact_id", "patient_root")
    reports = li.groupBy("l_partkey").agg(F.collect_set(F.concat(F.lit("O"), "l_orderkey")).alias("parents")).select(F.concat(F.lit("R"), "l_partkey").alias("fact_id"), F.lit("report").alias("type"), "parents")
    return ingest.resolve_roots(reports.unionByName(src.roots(spark, d).select("fact_id", F.lit("patient_registration").alias("type"), _empty().alias("parents"))), e)


@register("""SELECT 'C'||c_custkey AS fact_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def q80_hidden(spark: SparkSession, d: str) -> DataFrame:
    """What a nurse may not see, by rules of the table and by those that facts carry."""
    facts = src.roots(spark, d)
    names = lambda *x: F.array(*[F.lit(r) for r in x]).cast("array<string>")
    own = F.struct(names("nurse").alias("denied_roles"), names().alias("allowed_roles"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("expires_at"))
    none = F.struct(names().alias("denied_roles"), names().alias("allowed_roles"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("expires_at"))
    carried = facts.select("fact_id", F.when(F.col("c_mktsegment") == "BUILDING", own).when(F.col("c_mktsegment") == "HOUSEHOLD", none).alias("clearance"))
    table = facts.where("c_mktsegment = 'MACHINERY'").select("fact_id", names().alias("denied_roles"), names("dept:genetics").alias("allowed_roles"), F.lit(None).cast("string").alias("expires_at"))
    old = facts.where("c_mktsegment = 'FURNITURE'").select("fact_id", names("nurse").alias("denied_roles"), names().alias("allowed_roles"), F.lit("2001-01-01").alias("expires_at"))
    return clearance.hidden_from(carried, table.unionByName(old), ["nurse"], "2024-06-01 00:00:00")


@register("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN sha256(doc_id::VARCHAR) END AS id FROM documents""")
def q81_read_id(spark: SparkSession, d: str) -> DataFrame:
    """Identities shown with a prefix and read again; those in capitals are none."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    text = F.when(F.col("doc_id") % 3 == 0, canon.show_id(h)).when(F.col("doc_id") % 3 == 1, h).otherwise(F.upper(h))
    return src.table(spark, d, "documents").select("doc_id", canon.read_id(text).alias("id"))


@register("""SELECT o_orderkey::BIGINT AS k, 'fhir_encounter: {"a":'||to_json(o_orderpriority)||',"b":"x\\u003cy"}' AS whole, 'fhir_encounter: '||least(o_orderpriority, 'x<y') AS line FROM orders""")
def q82_renderings(spark: SparkSession, d: str) -> DataFrame:
    """Facts whole and as a line."""
    content = F.concat(F.lit('{"b":"x<y","a":'), canon.json_string(F.col("o_orderpriority")), F.lit("}"))
    o = src.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.lit("fhir_encounter").alias("type"), content.alias("content"))
    return o.select("k", flatten.content_whole("type", "content").alias("whole"), flatten.content_line("type", "content").alias("line"))


@register(f"WITH {INDEX} SELECT patient_root, fact_id, CASE type WHEN 'fhir_condition' THEN 'condition' WHEN 'fhir_medicationrequest' THEN 'medication' WHEN 'clinical_note' THEN 'note' END AS kind, ts AS day, text AS title FROM idx WHERE type <> 'fhir_observation'")
def q83_display_rows(spark: SparkSession, d: str) -> DataFrame:
    i = _index(spark, d).withColumn("type", F.when(F.col("type") == "fhir_observation", "fhir_else").otherwise(F.col("type")))
    return flatten.display_rows(i.withColumn("summary", F.concat("type", F.lit(": "), "text")))


@register("""WITH h AS (SELECT user_id AS query, event_id::VARCHAR AS fact_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id)::INTEGER AS rank, event_type AS text FROM events), u AS (SELECT query, fact_id, rank, sum(15 + strlen(text) // 3) OVER (PARTITION BY query ORDER BY rank, fact_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM h) SELECT * FROM u WHERE used <= 300""")
def q84_arm_items(spark: SparkSession, d: str) -> DataFrame:
    """What plain search gives a question within its tokens."""
    from pyspark.sql import Window

    e = src.table(spark, d, "events")
    hits = e.select(F.col("user_id").alias("query"), F.col("event_id").cast("string").alias("fact_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id")).alias("rank"), F.col("event_type").alias("text"))
    return evalkit.arm_items(hits, 300)


@register("""WITH r AS (SELECT event_type AS arm, event_id % 3 AS k FROM events) SELECT arm, count(*)::BIGINT AS n, round(avg(k / 2.0), 6)::DOUBLE AS recall, round(avg(0.5), 6)::DOUBLE AS precision, sum(k)::BIGINT AS tokens, round(avg((k = 1)::INTEGER), 6)::DOUBLE AS agreement FROM r GROUP BY 1""")
def q85_arm_summary(spark: SparkSession, d: str) -> DataFrame:
    """Answers scored and summed up by arm."""
    k = F.col("event_id") % 3
    r = src.table(spark, d, "events").select(F.col("event_type").alias("arm"), (k / 2).alias("recall"), F.lit(0.5).alias("precision"), k.alias("tokens"), F.when(k == 0, "I can't say").when(k == 1, "so it is. answer:  b").otherwise("Answer: A").alias("answer_text"), F.lit("B").alias("expected"))
    return evalkit.arm_summary(evalkit.answers_right(r))


@register(f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY patient_root ORDER BY category, scenario_id) AS n FROM ({ORACLES['q48_scenario_order']})) SELECT scenario_id, patient_root FROM s WHERE n <= 3")
def q86_scenario_cap(spark: SparkSession, d: str) -> DataFrame:
    from factgraph.catalogue import q48_scenario_order

    return evalkit.at_most_per_patient(q48_scenario_order(spark, d), 3).select("scenario_id", "patient_root")


@register("""SELECT user_id, sum(CASE WHEN user_id % 3 = 0 THEN 100 ELSE 1 END)::BIGINT AS weight FROM events GROUP BY 1""")
def q87_replaced_patients(spark: SparkSession, d: str) -> DataFrame:
    """Some patients' rows are replaced by what is derived afresh."""
    from factgraph.streaming.incremental import replace_patients

    e = src.table(spark, d, "events").select(F.col("user_id").alias("patient_root"), F.lit(1).alias("w"))
    hit = e.where("patient_root % 3 = 0")
    return replace_patients(e, hit.withColumn("w", F.lit(100)), hit).groupBy(F.col("patient_root").alias("user_id")).agg(F.sum("w").alias("weight"))


@register(f"""WITH {CUR.replace("FROM rule JOIN", "FROM (SELECT * FROM rule WHERE rule_version <> 'r3') JOIN")} SELECT patient_root, a, b, array_to_string(list_sort(string_split(tag, '|')), '|') AS tag, relation, severity, created_at FROM cur""")
def q88_rules_in_force(spark: SparkSession, d: str) -> DataFrame:
    """Rules read from a file, decoded from their facts, those in force applied."""
    import json

    from factgraph.catalogue import CURATED

    ends = {"r1": ("2020-01-01", ""), "r2": ("", "2030-01-01"), "r3": ("", "2024-05-31")}
    text = json.dumps({"rules": [{"rule_id": v, "tag_pairs": [[a, b]], "relation": r, "severity": s, "evidence_ids": ["e"], "author": "me", "published_at": "2024-01-01", "effective_from": ends[v][0], "effective_to": ends[v][1]} for v, a, b, s, r in CURATED]})
    rules = corrections.in_force(rulefiles.curated_pairs(spark, rulefiles.read_rules(text)), "2024-06-01 00:00:00")
    found = links.curated(_tags(spark, d), rules.select("rule_version", "tag_a", "tag_b", "severity", "relation"))
    return found.select("patient_root", "a", "b", "tag", "relation", "severity", "created_at")


@register(f"WITH {TURN} SELECT conv_id, fact_id, text FROM turn WHERE turn <= 2")
def q89_bundle_load(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the patients asked for with what they go back to: the first three turns."""
    t = src.turns(spark, d)
    up = graph.reach(t.where("turn = 2").select("fact_id"), t.where(F.col("parent_id").isNotNull()).select(F.col("fact_id").alias("src"), F.col("parent_id").alias("dst")), 2).select("fact_id").distinct()
    few = t.where("turn <= 2").select("fact_id").distinct()
    return t.join(up.unionByName(few).distinct(), "fact_id").select("conv_id", "fact_id", "text")


@register("""SELECT count(*)::BIGINT AS facts FROM (SELECT DISTINCT doc_id FROM documents)""")
def q90_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The fingerprint of a set of facts doesn't depend on their order or place."""
    f = src.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fact_id")).distinct()
    a, b = runs.dataset_fingerprint(f), runs.dataset_fingerprint(f.repartition(7, F.reverse("fact_id")))
    return a.join(b.select("fingerprint"), "fingerprint").select("facts")
