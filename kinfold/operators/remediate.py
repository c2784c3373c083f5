"""Remediation of violations: a steward's edits are merged into the row, judged again and, if clean, loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import normalize_email, normalize_name, normalize_phone, present
from kinfold.operators import dq
from kinfold.operators.load import apply_updates, decide_loads, payload_diff
from kinfold.operators.materialize import cut

#: Fields of a person that edits may touch.
FIELDS = ("external_id", "first_name", "last_name", "email", "phone", "notes")


def edited(violations: DataFrame, edits: DataFrame) -> DataFrame:
    """Violations that are open and still have their row, with the merged payload and its diff; others with a refusal.

    violations: violation_id, status, payload (a map, null if the row is gone). edits: violation_id, edits (a map).
    Blank values of an edit clear the field; fields that are not FIELDS are dropped.
    """
    both = edits.join(violations, "violation_id", "left")
    allowed = F.map_filter("edits", lambda k, v: k.isin(*FIELDS))
    base = F.map_filter("payload", lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    merged = F.map_concat(F.coalesce(base, F.create_map().cast("map<string,string>")), F.transform_values(allowed, lambda k, v: F.trim(v)))
    refusal = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "open", "not_open").when(F.col("payload").isNull(), "detached")
    out = both.withColumns({"refusal": refusal, "edited_payload": F.when(refusal.isNull(), merged)})
    return out.withColumn("diff", F.when(F.col("refusal").isNull(), payload_diff("payload", "edited_payload")))


def remediate(violations: DataFrame, edits: DataFrame, core: DataFrame, id_map: DataFrame, at: Column, rules: list[dq.Rule] | None = None) -> dict[str, DataFrame]:
    """results (violation_id, outcome, rule_codes, diff, load_action, entity_id), violations, core and log after the edits.

    Any violation that is left, even a warning, rejects the edit (validation_failed) and leaves all as it was; refused
    edits say why. What passes is loaded like rows of a run, in the order of the violations, with the edited fields as
    manual values, and its violation becomes fixed.
    """
    tried = edited(violations, edits)
    read = lambda f: F.try_element_at("edited_payload", F.lit(f)).alias(f)
    judged = cut(dq.judge(tried.select("violation_id", "refusal", "diff", "edited_payload", *[read(f) for f in FIELDS]), rules or dq.person_rules(contact_required=True)), "remediated")
    passed = judged.filter(F.col("refusal").isNull() & (F.size("violations") == 0))
    a, b = normalize_name("first_name"), normalize_name("last_name")
    clean = passed.select(
        F.col("violation_id").alias("clean_id"), F.lit("manual").alias("external_system"), "external_id", normalize_email("email").alias("mail"), normalize_phone("phone").alias("phone"),
        F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b)).alias("name"),
    )
    decided = decide_loads(clean, core.select("person_id", F.lower("email").alias("mail"), F.col("phone_e164").alias("phone"), "name"), id_map)
    manual = F.transform_values("diff", lambda k, v: v["after"])
    rows = decided.join(passed.select(F.col("violation_id").alias("clean_id"), "first_name", "last_name", "email", F.col("phone").alias("phone_e164"), "notes", manual.alias("manual")), "clean_id")
    loaded, after, log = apply_updates(rows, core, ("first_name", "last_name", "email", "phone_e164", "notes"))
    loaded = cut(loaded.select("clean_id", "load_action", "entity_id"), "loaded")
    outcome = F.coalesce("refusal", F.when(F.size("violations") > 0, "validation_failed").otherwise("succeeded"))
    results = judged.join(loaded.withColumnRenamed("clean_id", "violation_id"), "violation_id", "left").select("violation_id", outcome.alias("outcome"), F.when(F.col("refusal").isNull(), F.transform("violations", lambda v: v["rule_code"])).otherwise(F.array().cast("array<string>")).alias("rule_codes"), "diff", "load_action", "entity_id")
    fixed = results.filter("outcome = 'succeeded'").select("violation_id", F.lit(True).alias("_fixed")).distinct()
    marked = violations.join(fixed, "violation_id", "left").withColumns({"status": F.when(F.col("_fixed"), "fixed").otherwise(F.col("status")), "remediated_at": F.when(F.col("_fixed"), at)}).drop("_fixed")
    return {"results": results, "violations": marked, "core": after, "log": log}


def audit_entries(results: DataFrame, user_id: int, at: Column) -> DataFrame:
    """What is recorded of each edit: who, when, how it ended, the rules that failed and the fields that changed."""
    outcome = F.when(F.col("outcome") == "succeeded", "success").otherwise(F.col("outcome"))
    return results.select("violation_id", F.lit(user_id).alias("user_id"), at.alias("at"), outcome.alias("outcome"), "rule_codes", F.array_sort(F.map_keys(F.coalesce("diff", F.create_map().cast("map<string,struct<before:string,after:string>>")))).alias("fields"))


def open_violations(violations: DataFrame) -> DataFrame:
    return violations.filter((F.col("status") == "open") & present("record_key").isNotNull())
