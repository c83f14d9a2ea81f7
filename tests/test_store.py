import json

import pytest
from pyspark.sql import functions as F

from factgraph.sources import bundles
from factgraph.store import FactStore
from test_sources import _bundle


def test_from_bundles_to_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(_bundle()))
    (tmp_path / "in" / "hospitalInformation1.json").write_text(json.dumps(_bundle()))
    none = F.array().cast("array<string>")
    fresh = bundles.bundle_facts(bundles.read_bundles(spark, str(tmp_path / "in"))).select("fact_id", "patient_root", "type", "ts", F.lit(None).cast("string").alias("author"), "parents", none.alias("amends"), none.alias("retracts"), "content", F.col("fact_id").alias("computed_id"))
    store = FactStore(spark, str(tmp_path / "store"))
    assert store.append_facts(fresh, empty=True).count() == 0
    store.append_facts(fresh)
    assert store.facts().count() == 5
    store.reindex()
    assert tuple(store.verify().first()) == (5, 0, 0)
    patient = store.list_patients(["nurse"]).first().fact_id
    assert store.timeline(patient, ["nurse"]).count() == 5
    hit = store.search_tags("risk:bleeding", patient).first().fact_id
    assert [r.depth for r in store.ancestors(hit).orderBy("depth").collect()] == [0, 1, 2]
    assert store.search("visit", roles=["nurse"]).count() == 1 and store.links(hit).count() == 0
    rules = spark.createDataFrame([(hit, ["nurse"], [], None)], "fact_id string, denied_roles array<string>, allowed_roles array<string>, expires_at string")
    assert store.timeline(patient, ["nurse"], rules).count() == 4
    assert store.get_fact(hit, ["nurse"], rules).first().content == '{"_restricted":true}'
    got = store.retrieve(spark.createDataFrame([("q", hit)], "query string, fact_id string")).collect()
    assert {r.fact_id for r in got} >= {hit, patient}


def _two_patients(spark, folder):
    """A store of two patients with notes, a pair of drugs that a curated rule links, and the rule."""
    from factgraph.functions import canon
    from factgraph.sources.rules import read_rules

    store, first = FactStore(spark, folder), True
    made = {}

    def add(name, patient, type_, content, ts, parents=(), **more):
        nonlocal first
        fact = {"type": type_, "timestamp": ts, "author": "me", "parents": list(parents), "content": content} | more
        fact["fact_id"] = canon.fact_identity(fact)
        bad = store.append_one(fact, patient or fact["fact_id"], empty=first)
        first = False
        made[name] = fact["fact_id"]
        return bad.collect()

    drug = lambda code: {"status": "active", "medicationCodeableConcept": {"coding": [{"system": "http://www.nlm.nih.gov/research/umls/rxnorm", "code": code}]}}
    assert add("ann", None, "patient_registration", {"name": "Ann"}, "1970-01-01") == []
    add("visit", made["ann"], "fhir_encounter", {"type": [{"text": "checkup visit"}]}, "2020-01-01", [made["ann"]])
    add("warfarin", made["ann"], "fhir_medicationrequest", drug("855332"), "2020-01-02", [made["visit"]])
    add("ibuprofen", made["ann"], "fhir_medicationrequest", drug("310965"), "2020-01-03", [made["visit"]])
    add("note", made["ann"], "clinical_note", {"raw_text": "# Note\nbleeding after the checkup"}, "2020-02-01", [made["visit"]])
    rule = read_rules(json.dumps({"rules": [{"rule_id": "r", "tag_pairs": [["atc:m01ae01", "atc:b01aa03"]], "relation": "interaction", "severity": "warning", "evidence_ids": ["e"], "author": "me", "published_at": "2020-01-01"}]}))[0]
    assert store.append_one(rule, None).count() == 0
    return store, made, add


def test_store_answers_by_role_and_keeps_an_audit(spark, tmp_path):
    from factgraph.functions.embed import hash_embedder
    from factgraph.operators import corrections

    store, made, add = _two_patients(spark, str(tmp_path / "store"))
    run = store.reindex()
    assert store.current() == run and tuple(store.verify().first()) == (6, 0, 0) and all(r.verified for r in store.checked(list(made.values())).collect())
    link = store.links(made["warfarin"], "interaction").collect()
    assert [(r.other, r.severity) for r in link] == [(made["ibuprofen"], "warning")] and store.patient_links(made["ann"]).count() >= 1
    assert [r.fact_id for r in store.search("checkup").collect()] != [] and store.search("checkup NOT bleeding").count() == 1 and store.search("checkup", types=["clinical_note"]).count() == 1
    assert store.active("medications").count() == 2 and [r.patients for r in store.resource_counts().collect()] == [1, 0, 1, 0, 0, 1, 0, 0]
    assert store.table("activity").first().last_visit_at == "2020-02-01"
    # a rule hides a drug from nurses: everywhere
    store.add_rule(made["ibuprofen"], ["nurse"], [], "admin", "2020-01-01T00:00:00Z")
    nurse = {"roles": ["nurse"]}
    assert store.timeline(made["ann"], **nurse).count() == 4 and store.links(made["warfarin"], **nurse).count() == 0 and store.search_tags("atc:m01ae01", **nurse).count() == 0
    assert store.get_fact(made["ibuprofen"], **nurse).first().content == '{"_restricted":true}' and store.get_fact(made["ibuprofen"], ["emergency"]).first().access
    assert not store.ancestors(made["ibuprofen"], **nurse).first().access
    nodes, edges, ends = store.graph(made["ann"], **nurse)
    assert (nodes.count(), edges.count(), ends.count()) == (4, 3, 0)
    got = {r.fact_id for r in store.retrieve_for(tags=["risk:bleeding"], **nurse).collect()}
    assert made["warfarin"] in got and made["ibuprofen"] not in got
    found = store.retrieve_for(tags=["risk:bleeding"], roles=["specialist"]).collect()
    assert made["ibuprofen"] in {r.fact_id for r in found} and any(r.links for r in found) and all(r.content for r in found if r.tier == 0 and r.shape == "full") and any("atc:b01aa03" in r.tags for r in found)
    # vectors
    assert store.embed(hash_embedder(16), 16) >= 4 and store.embed(hash_embedder(16), 16) == 0
    assert store.vector_search("bleeding after the checkup", hash_embedder(16), 16, k=2, **nurse).count() <= 2
    # the rule goes, and the audit has both
    with pytest.raises(ValueError):
        store.delete_rules([store.rules().first().rule_id])
    store.delete_rules([store.rules().first().rule_id], "eve", ["system"], "2024-05-05T00:00:00Z")
    gone = store.audit().where("action = 'delete_rule'").first()
    assert (gone.user_id, gone.user_roles, gone.at, gone.fact_id) == ("eve", ["system"], "2024-05-05T00:00:00Z", made["ibuprofen"])
    assert store.rules().count() == 0 and sorted(r.action for r in store.audit().collect()) == ["create_rule", "delete_rule", "emergency_access"] and store.timeline(made["ann"], **nurse).count() == 5
    # a retraction and a rejected fact with what refers to it
    assert store.append_one(corrections.retract(made["note"], "wrong patient", "me", "2021-01-01"), made["ann"]).count() == 0
    assert [r.reason for r in add("lost", made["ann"], "fhir_observation", {}, "2021", ["nowhere"])] == ["unknown parents"]
    store.reindex()
    assert store.table("status").where(f"fact_id = '{made['note']}'").first().status == "retracted"
    seen = []
    assert store.reproject("2019", project=lambda batch: seen.extend(r.patient_root for r in batch.collect())).count() == 1 and seen == [made["ann"]]
    assert store.reproject("2019").count() == 0


def test_untrusted_rules_do_not_count(spark, tmp_path):
    from factgraph.operators import trust

    store, _, _ = _two_patients(spark, str(tmp_path / "store"))
    seed, key = trust.new_key("k", "o", ["knowledge_release"])
    policy = {"schema": trust.POLICY_V1, "tenant_id": "t", "require_knowledge_release": True, "minimum_knowledge_approvals": 1, "organizations": [{"organization_id": "o", "organization_name": "O"}], "keys": [key]}
    with pytest.raises(trust.TrustError):
        store.reindex(policy=policy)
    org = policy["organizations"][0]
    rel = trust.release("r1", org, [f["fact_id"] for f in store.knowledge()], "me", "2020-02-01T00:00:00Z")
    assert store.append_one(rel, None).count() == 0
    assert store.append_one(trust.attest(seed, key, org, {"actor_id": "ann"}, "knowledge_release", rel["fact_id"], "sys", "2020-02-02T00:00:00Z"), None).count() == 0
    assert store.reindex(policy=policy) == store.current()


def test_stream_equals_rebuild(spark, tmp_path):
    from factgraph.streaming.incremental import project_batch, project_stream

    schema = "patient_root string, fact_id string, x long"
    project = lambda facts: facts.groupBy("patient_root").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    folder, inbox = str(tmp_path / "out"), str(tmp_path / "in")
    rows = [(f"p{i % 4}", f"f{i}", i) for i in range(30)]
    for k, part in enumerate((rows[:10], rows[10:11], rows[11:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        project_stream(spark, inbox, schema, str(tmp_path / "checkpoint"), project_batch(folder, project)).awaitTermination()
    newest = spark.read.parquet(f"{folder}/rows/2")
    want = sorted(map(tuple, project(spark.createDataFrame(rows, schema)).collect()))
    assert sorted(map(tuple, newest.collect())) == want
    # a replayed batch changes nothing
    project_batch(folder, project)(spark.createDataFrame(rows[11:], schema), spark.createDataFrame([(p,) for p in {r[0] for r in rows[11:]}], "patient_root string"), 2)
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/rows/2").collect())) == want
