import base64
import hashlib
import json
import random
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from factgraph.functions import ed25519, flatten
from factgraph.operators import clearance, corrections, evalkit, search, trust
from factgraph.sources import bundles, frames


def _crc(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_crc_of_any_length():
    assert frames.crc32c(np.frombuffer(b"123456789", dtype=np.uint8), [0], [9]) == [0xE3069283]
    data = np.frombuffer(random.Random(1).randbytes(9000), dtype=np.uint8)
    ends = [0, 1, 4095, 4096, 4097, 8192, 9000]
    assert frames.crc32c(data, [0] * len(ends), ends) == [_crc(data[:n].tobytes()) for n in ends]
    assert frames.crc32c(data, [7], [9000], (11, 15)) == [_crc(data[7:18].tobytes() + data[22:].tobytes())]


def _fact(text):
    return hashlib.sha256(text.encode()).hexdigest(), text, "p", "2020-01-01T00:00:00Z"


@pytest.mark.parametrize("codec", [frames.RAW, frames.ZSTD])
def test_a_log_counts_up_to_its_first_damage(codec):
    parts = frames.encode([_fact("{}"), _fact("x" * 9000), _fact("é")], codec)
    whole = b"".join(parts)
    records, valid, why = frames.scan(whole)
    assert [frames.core_text(r) for r in records] == ["{}", "x" * 9000, "é"] and valid == len(whole) and why == ""
    at = len(parts[0])
    for damaged, reason in ((whole[:-1], "short frame"), (whole[:-40], "short frame"), (whole + b"\0" * 60, "bad header")):
        assert frames.scan(damaged)[2] == reason
    flipped = bytearray(whole)
    flipped[at + 50] ^= 1
    assert frames.scan(bytes(flipped))[1:] == (at, "checksum")
    assert frames.scan(b"") == ([], 0, "")


def test_logs_round_trip_in_segments(spark):
    rows = [(*_fact(f"fact {i}")[:2], None if i % 3 == 0 else f"p{i % 2}", "2020", i) for i in range(40)]
    df = spark.createDataFrame(rows, "fact_id string, core string, patient_root string, written_at string, append_seq long")
    logs = frames.append_frames(df, segment=10)
    got = frames.frames(logs).collect()
    assert {(r.fact_id, r.core, r.patient_root) for r in got} == {(a, b, c) for a, b, c, _, _ in rows} and all(r.verified for r in got)
    assert logs.count() == 12
    bad = spark.createDataFrame([("a", bytearray(b"".join(frames.encode([("00" * 32, "{}", "p", "t")])))), ("b", bytearray(b"junk")), ("c", None)], "path string, content binary")
    assert {r.path: (r.frames, r.damaged, r.failed_hashes) for r in frames.verify(bad).collect()} == {"a": (1, False, 1), "b": (0, True, 0), "c": (0, False, 0)}


def _bundle():
    note = base64.b64encode("\n# Visit\nwell".encode()).decode()
    return {"resourceType": "Bundle", "entry": [
        {"fullUrl": "urn:uuid:m", "resource": {"resourceType": "MedicationRequest", "id": "m", "authoredOn": "2020-01-02", "encounter": {"reference": "urn:uuid:e"}, "medicationReference": {"reference": "urn:uuid:d"}}},
        {"fullUrl": "urn:uuid:d", "resource": {"resourceType": "Medication", "id": "d", "code": {"coding": [{"system": "http://www.nlm.nih.gov/research/umls/rxnorm", "code": "309362"}]}}},
        {"fullUrl": "urn:uuid:e", "resource": {"resourceType": "Encounter", "id": "e", "period": {"start": "2020-01-05"}}},
        {"resource": {"resourceType": "Condition", "id": "c", "encounter": {"reference": "gone"}}},
        {"resource": {"resourceType": "DocumentReference", "id": "n", "status": "current", "date": "2020-01-01", "context": {"encounter": [{"reference": "urn:uuid:e"}, {"reference": "x"}]}, "content": [{"attachment": {"data": note}}]}},
        {"resource": {"resourceType": "DocumentReference", "id": "o", "status": "superseded"}},
        {"resource": {"resourceType": "Claim", "id": "x"}}, {"resource": None}, "junk",
        {"fullUrl": "urn:uuid:p", "resource": {"resourceType": "Patient", "id": "p", "birthDate": "1980-01-01", "name": [{"given": ["Ann"], "family": "Bo"}]}},
    ]}


def test_bundle_order_parents_and_content():
    facts = plain.map_bundle(_bundle())
    assert [(f["fhir_id"], f["ts"], f["parent_fhir_id"], f["parent_fallback"]) for f in facts] == [("p", "1980-01-01", None, False), ("e", "2020-01-05", "p", False), ("n", "2020-01-01", "e", False), ("m", "2020-01-02", "e", False), ("c", "2099-01-01", "p", True)]
    by = {f["fhir_id"]: f for f in facts}
    assert all(f["fact_id"] == trust.fact_identity({"type": f["type"], "timestamp": f["ts"], "parents": f["parents"], "content": json.loads(f["content"])}) for f in facts)
    assert by["n"]["warning"] and json.loads(by["n"]["content"])["raw_text"].startswith("\n# Visit") and by["n"]["type"] == "clinical_note"
    assert json.loads(by["p"]["content"])["name"] == "Ann Bo"
    assert plain.codings(json.loads(by["m"]["content"])) == [("http://www.nlm.nih.gov/research/umls/rxnorm", "309362")]
    shuffled = _bundle()
    random.Random(2).shuffle(shuffled["entry"])
    assert plain.map_bundle(shuffled) == facts


def test_bundles_that_cannot_be_read(spark):
    rows = [("a", json.dumps(_bundle())), ("b", "{not json"), ("c", None), ("d", "[]"), ("e", "{}")]
    df = spark.createDataFrame(rows, "path string, content string")
    assert bundles.bundle_facts(df).count() == 5
    assert {r.path: (r.readable, r.facts, r.dropped_notes, r.fallbacks) for r in bundles.bundle_report(df).collect()} == {"a": (True, 5, 1, 1), "b": (False, 0, 0, 0), "c": (False, 0, 0, 0), "d": (True, 0, 0, 0), "e": (True, 0, 0, 0)}


def test_tags_and_summaries(spark):
    rx = {"medicationCodeableConcept": {"coding": [{"system": "http://www.nlm.nih.gov/research/umls/rxnorm", "code": "309362", "display": "clopidogrel"}]}}
    rows = [("a", "p", "t", "fhir_medicationrequest", json.dumps(rx)), ("b", "p", "t", "fhir_encounter", "{}"), ("c", "p", "t", "note", '{"coding":[1,{"system":"","code":"x"}],"a":{"coding":"no"}}'), ("d", "p", "t", "note", None), ("e", "p", "t", None, "{bad")]
    got = flatten.tag_rows(spark.createDataFrame(rows, "fact_id string, patient_root string, ts string, type string, content string")).collect()
    assert sorted((r.fact_id, r.tag) for r in got) == [("a", t) for t in ("atc:b01ac04", "organ:cardiovascular", "organ:hematologic", "risk:bleeding", "rxnorm:309362")] + [("b", "temporal:encounter")]
    assert plain.summary("fhir_medicationrequest", rx) == "fhir_medicationrequest: clopidogrel"
    assert plain.summary("fhir_observation", {"code": {"text": "Girth"}, "valueQuantity": {"value": 81.2040000002, "unit": "cm"}}) == "fhir_observation: Girth 81.204 cm"
    assert plain.summary("fhir_observation", {"code": {"text": "Smoking"}, "valueQuantity": {"unit": "mg"}, "valueCodeableConcept": {"text": "never"}}) == "fhir_observation: Smoking never"
    assert plain.summary("x", {"b": ["z", {"c": "a"}]}) == "x: a" and plain.summary("x", None) == "x"
    assert plain.search_text("x", {"b": ["z", {"c": "a"}], "n": 1}) == "a z"
    assert plain.render("x", {"b": "<&>"}, 0) == 'x: {"b":"\\u003c\\u0026\\u003e"}' and plain.render("x", {"b": "z"}, 2) == ""


def test_signature_vector():
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    key = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    assert ed25519.public_key(seed) == key and ed25519.verify(key, b"\x72", ed25519.sign(seed, b"\x72"))
    assert not ed25519.verify(key, b"\x73", ed25519.sign(seed, b"\x72")) and not ed25519.verify(key, b"", b"")


SEED, NOW = b"\1" * 32, datetime(2024, 6, 1, tzinfo=timezone.utc)
ORG = {"organization_id": "o", "organization_name": "O"}
KEY = {"key_id": "k", "organization_id": "o", "algorithm": "Ed25519", "public_key": base64.b64encode(ed25519.public_key(SEED)).decode(), "trusted_for": ["knowledge_release"]}


def _policy(**key):
    return {"schema": trust.POLICY_V1, "tenant_id": "t", "require_knowledge_release": True, "minimum_knowledge_approvals": 1, "organizations": [ORG], "keys": [KEY | key]}


def _knowledge(to=""):
    rule = corrections.curated_rule("r", [("b", "a")], "interaction", "warning", ["e"], "doc", "2024-01-01T00:00:00Z")
    rel = trust.release("r1", ORG, [rule["fact_id"]], "doc", "2024-01-02T00:00:00Z", "2024-01-01", to)
    return [rule, rel, trust.attest(SEED, KEY, ORG, {"actor_id": "doc"}, "knowledge_release", rel["fact_id"], "s", "2024-01-03T00:00:00Z")]


def test_release_is_accepted():
    facts = _knowledge("2024-06-01")
    assert trust.check_knowledge(facts, _policy(), NOW.replace(hour=23))["actors"] == ["doc"]
    assert trust.may_activate([], None, NOW) and trust.may_activate(facts, _policy(), NOW)


@pytest.mark.parametrize("break_it", ["claim", "revoked", "expired", "early", "extra", "ended", "unsigned", "signature", "org", "purpose"])
def test_release_fails_closed(break_it):
    facts, policy = _knowledge("2024-05-31" if break_it == "ended" else ""), _policy()
    if break_it == "claim":
        facts[1] = facts[1] | {"content": facts[1]["content"] | {"release_id": "other"}}
    elif break_it in ("revoked", "expired", "early"):
        policy = _policy(**{"revoked": {"revoked_at": "2024-05-01T00:00:00Z"}, "expired": {"valid_to": "2024-01-02T00:00:00Z"}, "early": {"valid_from": "2024-02-01T00:00:00Z"}}[break_it])
    elif break_it == "extra":
        facts.append(corrections.curated_rule("r2", [("c", "a")], "interaction", "info", [], "doc", "2024-01-01T00:00:00Z"))
    elif break_it == "unsigned":
        facts.pop()
    elif break_it == "signature":
        c = facts[2]["content"]
        facts[2] = facts[2] | {"content": c | {"statement": c["statement"] | {"source_system_id": "other"}}}
        facts[2]["fact_id"] = trust.fact_identity(facts[2])
    elif break_it == "org":
        policy["organizations"] = [{"organization_id": "x", "organization_name": "X"}]
    elif break_it == "purpose":
        policy = _policy(trusted_for=["fhir_import"])
    with pytest.raises(trust.TrustError):
        trust.check_knowledge(facts, policy, NOW)


def test_many_attestations(spark):
    a = _knowledge()[2]
    rows = [(i, a["type"], a["timestamp"], a["author"], a["parents"], json.dumps(a["content"])) for i in (a["fact_id"], "0" * 64)] + [("n", None, None, None, [], "null")]
    df = spark.createDataFrame(rows, "fact_id string, type string, timestamp string, author string, parents array<string>, content string")
    assert {r.fact_id: r.ok for r in trust.verified(df, _policy(), NOW).collect()} == {a["fact_id"]: True, "0" * 64: False, "n": False}


def test_clearance_rules_and_audit(spark):
    from pyspark.sql import functions as F

    rule = clearance.new_rule(spark, "f", ["insurance"], [], "u", "2024")
    rules = clearance.add_rules(rule, clearance.new_rule(spark, "f", ["insurance"], [], "u", "2024"))
    assert rules.count() == 1 and clearance.delete_rules(rules, rule).count() == 0
    assert [r.action for r in clearance.audit_of(rule, "create_rule", ["specialist"]).collect()] == ["create_rule"]
    for denied, user in ((["system"], "u"), (["nobody"], "u"), (["dept:none"], "u"), (["family"], ""), ([], "u")):
        with pytest.raises(ValueError):
            clearance.new_rule(spark, "f", denied, [], user, "2024")
    row = spark.createDataFrame([(" nurse, system ,,",)], "h string").select(clearance.viewer_roles(F.col("h")).alias("a"), clearance.viewer_roles(F.col("h"), True).alias("b")).first()
    assert (row.a, row.b) == (["nurse"], ["nurse", "system"])


def test_rules_of_arrival(spark):
    rows = [("a", "note", None, ["x"], ["k"], [], "p", "a"), ("b", "retraction", "me", [], [], ["q"], "p", "b"), ("c", "note", "me", ["gone"], [], [], "p", "z"), ("d", "note", None, ["a"], [], [], "p", "d")]
    df = spark.createDataFrame(rows, "fact_id string, type string, author string, parents array<string>, amends array<string>, retracts array<string>, patient_root string, computed_id string")
    known = spark.createDataFrame([("k", "p"), ("q", "other"), ("x", "p")], "fact_id string, patient_root string")
    assert sorted(map(tuple, corrections.rejected(df, known).collect())) == [("a", "author"), ("b", "other patient in retracts"), ("b", "subject"), ("c", "identity"), ("c", "unknown parents"), ("d", "refers to a rejected fact")]
    rules = spark.createDataFrame([("1", "", None), ("2", "2024-06-02", ""), ("3", "2024-01-01", "2024-06-01")], "id string, effective_from string, effective_to string")
    assert [r.id for r in corrections.in_force(rules, "2024-06-01 12:00:00").collect()] == ["1"]


def test_knn_in_blocks_is_the_same(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)], i % 3) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = v.selectExpr("vec_id AS query_id", "embedding AS vector", "label")
    for part in (None, "label"):
        assert sorted(map(tuple, search.knn(v, q, 3, part).collect())) == sorted(map(tuple, search.knn(v, q, 3, part, block=7).collect()))


def test_scenarios_stop_and_go_on(spark):
    wanted = spark.createDataFrame([("s1", "fts"), ("s2", "fts")], "scenario_id string, arm string")
    assert [tuple(r) for r in evalkit.pending(wanted, wanted.limit(1)).collect()] != [] and evalkit.pending(wanted, wanted).count() == 0
    none = spark.createDataFrame([("k", None)], "k string, attribution string")
    assert evalkit.claim_tally(none, "k").first().rate == 0.0


def test_logs_read_together_are_read_as_alone(spark):
    made = [frames.encode([(f"{i:064x}", "{}" * i, None, "t") for i in range(n)]) for n in (3, 0, 1, 5)]
    logs = [b"".join(m) for m in made]
    logs += [logs[3][:-1], logs[0][:60] + b"\x00" + logs[0][61:], b"x" * 50, b""]
    assert list(frames.scan_all(logs)) == [frames.scan(c) for c in logs]
    rows = spark.createDataFrame([(str(i), bytearray(c)) for i, c in enumerate(logs)] + [("none", None)], "path string, content binary").coalesce(1)
    assert {r.path: (r.frames, r.valid_upto, r.reason) for r in frames.verify(rows).collect()} == {str(i): (len(frames.scan(c)[0]), *frames.scan(c)[1:]) for i, c in enumerate(logs)} | {"none": (0, 0, "")}
    assert frames.frames(rows).count() == sum(len(frames.scan(c)[0]) for c in logs)


def test_bundles_give_summaries_and_codings_as_their_content_does(spark):
    df = spark.createDataFrame([("a", json.dumps(_bundle())), ("c", None)], "path string, content string")
    f = bundles.bundle_facts(df, summary=True, codings=True)
    rows = f.collect()
    assert [r.summary for r in rows] == [plain.summary(r.type, json.loads(r.content)) for r in rows]
    assert [sorted((c.system, c.code) for c in r.codings) for r in rows] == [sorted(plain.codings(json.loads(r.content))) for r in rows]
    assert sorted(flatten.tag_rows(f).collect()) == sorted(flatten.tag_rows(f.drop("codings")).collect())


def test_bundles_equal_their_plain_form(spark):
    """Odd numbers, escapes, keys beyond the basic plane, several patients, medications and encounters of one name, a bundle without a patient."""
    odd, many, none = _bundle(), _bundle(), _bundle()
    odd["entry"][0]["resource"]["x"] = [1e21, 1e-7, 0.1, 12345678901234567890, -0.0, -2.5e-9, 1.5, 100, "a\u001f\u000b\\\"\u0001\n", "\\u000B", {"Z": {}, "a": [], "é": None, "\U0001f600": 1, "￮": 2}]
    many["entry"] += [{"fullUrl": "urn:uuid:e", "resource": {"resourceType": "Encounter", "id": "e2", "type": [{"text": "later"}], "period": {"start": "2021-01-01"}}}, {"resource": {"resourceType": "Patient", "id": "p2", "name": [{"family": ["Cy"]}]}}, {"fullUrl": "urn:uuid:d", "resource": {"resourceType": "Medication", "id": "d3"}}]
    many["entry"] += [{"resource": {"resourceType": "Observation", "id": "q", "context": {"encounter": [{"reference": "e"}]}, "code": {"coding": [{"display": "Girth"}]}, "valueQuantity": {"value": 81.2040000002, "unit": "cm"}}}] * 2
    none["entry"].pop()
    rows = [(k, json.dumps(b)) for k, b in (("a", _bundle()), ("many", many), ("none", none), ("odd", odd))]
    got = bundles.bundle_facts(spark.createDataFrame(rows, "path string, content string"), summary=True, codings=True).collect()
    got = [r.asDict(True) for r in sorted(got, key=lambda r: (r.path, r.append_seq))]
    want = [f | {"path": k} for k, text in rows for f in plain.map_bundle(json.loads(text))]
    assert [{k: r[k] for k in want[0]} for r in got] == want
    assert [r["summary"] for r in got] == [plain.summary(f["type"], json.loads(f["content"])) for f in want]


def test_content_equals_its_plain_form(spark):
    kinds = ("fhir_observation", "fhir_encounter", "clinical_note", "x", None)
    texts = ["{}", "[]", "null", "3", '"s"', "", "{bad", None, '{"code":7,"type":[]}', '{"code":{"coding":[{"code":"c"}]},"valueQuantity":{"value":-0.0004,"unit":"u"}}', '{"code":{"text":"t"},"valueQuantity":{"value":true},"valueCodeableConcept":{"text":"v"}}',
        '{"code":{"text":"t"},"valueQuantity":{"value":1234567.0005}}', '{"raw_text":"\\n  \\t# h\\r\\nx","a":["é","z",["<&",{"b":""}]]}', '{"raw_text":"' + "é" * 150 + '"}', '{"a":"[{","b":"\\\\","c":{"d":[[["deep"]]]}}', '{"type":[{"text":"visit"}]}']
    rows = [(i, k, c) for i, (k, c) in enumerate((k, c) for k in kinds for c in texts)]
    df = spark.createDataFrame(rows, "i int, k string, c string")
    got = df.select("i", flatten.content_summary("k", "c").alias("s"), flatten.content_search_text("k", "c").alias("t"), flatten.content_line("k", "c").alias("l"), flatten.content_whole("k", "c").alias("w")).orderBy("i").collect()
    for r, (_, k, c) in zip(got, rows):
        held = flatten.parse(c)
        assert (r.s, r.t, r.l, r.w) == (plain.summary(k or "", held), plain.search_text(k or "", held), plain.render(k or "", held, 1), plain.render(k or "", held, 0)), (k, c)


def test_content_is_walked_once_for_all_texts(spark):
    kinds = ("fhir_observation", "clinical_note", "x", None)
    texts = ["{}", "null", "{bad", None, '{"code":{"coding":[{"code":"c"}]},"valueQuantity":{"value":-0.0004,"unit":"u"}}', '{"raw_text":"# h\\nx","a":["é","z",["<&",{"b":""}]]}', '{"a":"[{","n":1e21,"c":{"d":[[["deep"]]]}}']
    rows = [(i, k, c) for i, (k, c) in enumerate((k, c) for k in kinds for c in texts)]
    df = flatten.with_texts(spark.createDataFrame(rows, "i int, type string, content string"))
    for r, (_, k, c) in zip(df.orderBy("i").collect(), rows):
        held = flatten.parse(c)
        assert (r.summary, r.text, r.line, r.whole) == (plain.summary(k or "", held), plain.search_text(k or "", held), plain.render(k or "", held, 1), plain.render(k or "", held, 0)), (k, c)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1 and plan.count("to_json") + plan.count("StructsToJson") <= 2, plan


def test_a_worker_holds_a_bounded_part_of_a_batch(spark):
    """What a worker holds of frames and logs doesn't follow from how many rows Spark hands it at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(2_500)]), pa.array([b""] * 2_500)], names=["path", "content"])
    assert [len(path) for path, _ in frames._parts([batch])] == [frames.ROWS, frames.ROWS, 500]
    ident = F.sha2(F.concat(F.lit("t"), "id"), 256)
    facts = spark.range(0, 2_500, 1, 1).select(ident.alias("fact_id"), F.concat(F.lit("t"), "id").alias("core"), F.concat(F.lit("P"), F.col("id") % 900).alias("patient_root"), F.lit("2020").alias("written_at"), F.col("id").alias("append_seq"))
    logs = frames.append_frames(facts, segment=500).coalesce(1)
    assert frames.verify(logs).agg(F.sum("frames"), F.bool_or("damaged"), F.sum("failed_hashes"), F.count("*")).first() == (2_500, False, 0, facts.select("patient_root", F.floor(F.col("append_seq") / 500)).distinct().count())
    assert frames.frames(logs).where("verified").select("fact_id", "core").exceptAll(facts.select("fact_id", "core")).isEmpty()
