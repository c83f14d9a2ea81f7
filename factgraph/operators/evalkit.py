"""Questions with known answers, and the metrics of retrieval that they serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_precision(rows: DataFrame, key: str) -> DataFrame:
    """Overlap of the sets `gold` and `got`; an empty side gives 0."""
    both = F.size(F.array_intersect("gold", "got"))
    part = lambda c: F.round(F.when(F.size(c) == 0, 0.0).otherwise(both / F.size(c)), 6)
    return rows.select(key, part("gold").alias("recall"), part("got").alias("precision"))


def scenario_id(patient, category, discriminator):
    return F.substring(F.sha2(F.concat_ws("|", patient, category, discriminator), 256), 1, 16)


def answer_choice(text):
    """A or B of an answer line, '' if there is none."""
    return F.upper(F.regexp_extract(text, r"(?i)Answer:\s*([AB])", 1))


#: Categories of questions and their wording; {a}, {b} are names.
QUESTIONS = {
    "medication_lookup": "Which drug was ordered because of '{a}'?",
    "temporal_order": "What happened earlier, '{a}' or '{b}'?",
    "encounter_context": "What was done during the visit '{a}' ({b})?",
    "medication_interaction_surface": "Which orders share the risk '{a}'?",
}


def _question(category: str, a: Column, b: Column | None = None) -> Column:
    head, rest = QUESTIONS[category].split("{a}")
    mid, *tail = rest.split("{b}")
    return F.concat(F.lit(head), a, F.lit(mid), *([b, F.lit(tail[0])] if b is not None else []))


def _scenario(rows: DataFrame, category: str, key: Column, question: Column, answer: Column, evidence: Column) -> DataFrame:
    return rows.select(scenario_id(F.col("patient_root"), F.lit(category), key).alias("scenario_id"), "patient_root", F.lit(category).alias("category"), question.alias("question"), answer.alias("answer"), evidence.alias("evidence"))


def medication_lookup(requests: DataFrame, conditions: DataFrame) -> DataFrame:
    """What was prescribed for a condition. requests: patient_root, fact_id, source_id, name, reasons (ids of conditions, in order); the first that is known counts."""
    c = conditions.select("patient_root", F.col("source_id").alias("reason"), F.col("fact_id").alias("c_id"), F.col("name").alias("c_name")).where(F.coalesce("c_name", F.lit("")) != "")
    rows = requests.where(F.coalesce("name", F.lit("")) != "").select("patient_root", "fact_id", "source_id", "name", F.posexplode("reasons").alias("at", "reason")).join(c, ["patient_root", "reason"])
    first = rows.groupBy("patient_root", "fact_id", "source_id", "name").agg(F.min(F.struct("at", "c_id", "c_name")).alias("c"))
    return _scenario(first, "medication_lookup", F.col("source_id"), _question("medication_lookup", F.col("c.c_name")), F.col("name"), F.array("fact_id", "c.c_id"))


def temporal_order(events: DataFrame) -> DataFrame:
    """Which of two neighbouring events came first; those of one time are not asked about. events: patient_root, fact_id, source_id, name, ts."""
    w = Window.partitionBy("patient_root").orderBy("ts", "source_id")
    later = {c: F.lead(c).over(w).alias(f"next_{c}") for c in ("fact_id", "source_id", "name", "ts")}
    rows = events.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("ts", F.lit("")) != "")).select("*", *later.values()).where(F.col("next_ts") > F.col("ts"))
    return _scenario(rows, "temporal_order", F.concat_ws("|", "source_id", "next_source_id"), _question("temporal_order", F.col("name"), F.col("next_name")), F.col("name"), F.array("fact_id", "next_fact_id"))


def encounter_context(encounters: DataFrame, children: DataFrame) -> DataFrame:
    """What was done in an encounter. encounters: patient_root, fact_id, source_id, name; children: encounter (fact id), fact_id, name, ts."""
    kids = children.groupBy(F.col("encounter").alias("fact_id")).agg(F.array_sort(F.collect_list(F.struct("ts", F.col("fact_id").alias("k"), "name"))).alias("k"))
    rows = encounters.join(kids, "fact_id")
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.lit("encounter"))
    return _scenario(rows, "encounter_context", F.col("source_id"), _question("encounter_context", name, F.col("source_id")), F.array_join("k.name", ", "), F.concat(F.array("fact_id"), F.col("k.k")))


def interaction_surface(requests: DataFrame) -> DataFrame:
    """What of a patient's prescriptions bears on a risk, for risks of two or more. requests: patient_root, fact_id, source_id, name, risks."""
    rows = requests.select("patient_root", "fact_id", "source_id", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("source_id")).alias("name"), F.explode("risks").alias("risk"))
    held = rows.groupBy("patient_root", "risk").agg(F.array_sort(F.collect_list(F.struct("source_id", "name", "fact_id"))).alias("m")).where(F.size("m") >= 2)
    return _scenario(held, "medication_interaction_surface", F.col("risk"), _question("medication_interaction_surface", F.col("risk")), F.array_join("m.name", ", "), F.col("m.fact_id"))


def at_most_per_patient(scenarios: DataFrame, n: int) -> DataFrame:
    """The first n scenarios of each patient by category and id: a cap that the caller asks for."""
    w = Window.partitionBy("patient_root").orderBy("category", "scenario_id")
    return scenarios.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def claim_tally(claims: DataFrame, key: str) -> DataFrame:
    """Counts of attributions and the share of hallucinated claims per key, 0 without any. claims: key, attribution (null: no claim)."""
    n = lambda a: F.count_if(F.col("attribution") == a)
    out = claims.groupBy(key).agg(n("supported").alias("supported"), n("context_out_all_in").alias("context_out"), n("hallucination").alias("hallucinated"))
    total = F.col("supported") + F.col("context_out") + F.col("hallucinated")
    return out.withColumn("rate", F.when(total > 0, F.round(F.col("hallucinated") / total, 6)).otherwise(0.0))


def arm_summary(results: DataFrame) -> DataFrame:
    """Per arm: runs, mean recall and precision, tokens, and the share of right answers; null where nothing was measured."""
    return results.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.col("right").cast("int")), 6).alias("agreement"))


def scenario_lines(scenarios: DataFrame) -> DataFrame:
    """The scenarios as JSON, a row (line) each, in order of patient, category and id; written with `write_lines`."""
    order = ["patient_root", "category", "scenario_id"]
    return scenarios.select(*order, F.to_json(F.struct("scenario_id", "patient_root", "category", "question", "answer", "evidence")).alias("line")).orderBy(*order).select("line")


def write_lines(lines: DataFrame, folder: str) -> None:
    """Adds lines to those of a folder; with `pending`, a run that stopped goes on where it was."""
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("append").text(folder)


def answers_right(results: DataFrame) -> DataFrame:
    """results (answer_text, expected) with choice and right; an answer without a choice is wrong."""
    return results.withColumn("choice", answer_choice(F.col("answer_text"))).withColumn("right", F.col("choice") == F.col("expected"))


def arm_items(hits: DataFrame, budget: int) -> DataFrame:
    """What an arm of plain search gives a question: hits (query, fact_id, rank, text) in rank order until the first that doesn't fit. For the vector arm rank by distance, for the text
    arm by score; the third arm is `retrieve`."""
    from factgraph.functions.canon import REFERENCE_TOKENS, token_estimate
    from factgraph.operators.context import pack_stop

    costs = hits.withColumn("tokens", F.lit(REFERENCE_TOKENS) + token_estimate(F.coalesce("text", F.lit(""))))
    return pack_stop(costs, budget, "query", ["rank", "fact_id"]).select("query", "fact_id", "rank", "used")


def percentiles(values: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """n, the nearest-rank percentiles named in `shares`, and worst by key."""
    found = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for name, p in shares.items()]
    return values.groupBy(key).agg(F.count("*").alias("n"), *found, F.max(value).alias("worst"))


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """(scenario_id, arm) that have no result yet: a run that stopped goes on there."""
    return wanted.join(done.select("scenario_id", "arm"), ["scenario_id", "arm"], "left_anti")
