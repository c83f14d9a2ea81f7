"""python -m factgraph COMMAND STORE ...: import bundles, publish a file of rules, reindex, begin a generation, reproject to it, correct, repair, counts, verify, trust, embed, or patients."""

from __future__ import annotations

import argparse
import json
import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from factgraph.functions.embed import hash_embedder
from factgraph.operators import corrections, trust
from factgraph.sources import bundles
from factgraph.sources.rules import read_rules
from factgraph.store import FactStore


def main() -> None:
    args = argparse.ArgumentParser(prog="factgraph", description=__doc__)
    args.add_argument("command", choices=("import", "rules", "reindex", "begin", "reproject", "correct", "repair", "counts", "verify", "trust", "embed", "patients"))
    args.add_argument("store")
    args.add_argument("bundles", nargs="?", help="import: a folder of bundles; rules: a file; trust: a policy; correct: the fact to correct")
    args.add_argument("--action", choices=("retract", "attest", "amend"), default="attest", help="of correct")
    args.add_argument("--content", help="of an amendment: a file with the new content as JSON")
    args.add_argument("--policy", help="of reindex and begin: a file with the trust policy, which is kept")
    args.add_argument("--author", default="")
    args.add_argument("--note", default="approved", help="of correct: the reason of a retraction, or approved or rejected")
    args.add_argument("--recent", default="2000-01-01", help="of reproject: patients seen since then come first")
    args.add_argument("--limit", type=int, default=64, help="of reproject: patients at once")
    args.add_argument("--first", action="store_true", help="the store is new")
    a = args.parse_args()
    spark = SparkSession.builder.appName("factgraph").getOrCreate()
    store = FactStore(spark, a.store, a.author)
    policy = None
    if a.policy:
        with open(a.policy, encoding="utf-8") as f:
            policy = json.load(f)
    if a.command == "import":
        if not a.bundles:
            args.error("import needs a folder of bundles")
        none = F.array().cast("array<string>")
        fresh = bundles.bundle_facts(bundles.read_bundles(spark, a.bundles)).select("fact_id", "patient_root", "type", "ts", F.lit(None).cast("string").alias("author"), "parents", none.alias("amends"), none.alias("retracts"), "content", F.col("fact_id").alias("computed_id"))
        store.append_facts(fresh, empty=a.first).show(100, truncate=False)
    elif a.command == "rules":
        with open(a.bundles, encoding="utf-8") as f:
            for fact in read_rules(f.read()):
                store.append_one(fact, None).show(truncate=False)
    elif a.command == "correct":
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        row = store.facts(["system"]).where(F.col("fact_id") == a.bundles).select("patient_root", "type").first()
        if row is None:
            args.error("no such fact")
        if a.action == "amend":
            if not a.content:
                args.error("an amendment needs its content")
            with open(a.content, encoding="utf-8") as f:
                made = corrections.amend(a.bundles, row.type, json.load(f), a.author, at)
        else:
            made = (corrections.retract if a.action == "retract" else corrections.attest)(a.bundles, a.note, a.author, at)
        store.append_one(made, row.patient_root).show(truncate=False)
    elif a.command == "begin":
        print(store.begin_generation(policy=policy))
    elif a.command == "reproject":
        store.reproject(a.recent, a.limit).show(a.limit, truncate=False)
    elif a.command == "repair":
        print("\n".join(store.repair()))
    elif a.command == "counts":
        store.counts().show()
    elif a.command == "trust":
        with open(a.bundles, encoding="utf-8") as f:
            print(trust.check_knowledge(store.knowledge(), json.load(f), datetime.now(timezone.utc)))
    elif a.command == "embed":
        print(store.embed(hash_embedder()))
    elif a.command == "reindex":
        print(store.reindex(policy=policy))
    elif a.command == "verify":
        store.verify().show()
    else:
        store.list_patients(["system"]).show(100, truncate=False)


if __name__ == "__main__":
    main()
