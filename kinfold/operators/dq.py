"""Row-level quality rules: one pass gives every row its violations, status and last error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import E164_PATTERN, EMAIL_PATTERN, parse_timestamp, present

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Rule:
    """A violation predicate over the row."""

    code: str
    severity: str
    message: str
    broken: Column


def person_rules(email: str = "email", phone: str = "phone", contact_required: bool = False) -> list[Rule]:
    e, p = present(email), present(phone)
    rules = [
        Rule("VOL_EMAIL_FORMAT", ERROR, "Email is not valid", F.coalesce(~e.rlike(EMAIL_PATTERN), F.lit(False))),
        Rule("VOL_PHONE_E164", ERROR, "Phone is not in E.164 format", F.coalesce(~p.rlike(E164_PATTERN), F.lit(False))),
    ]
    if contact_required:
        rules.insert(0, Rule("VOL_CONTACT_REQUIRED", WARNING, "Neither email nor phone is given", e.isNull() & p.isNull()))
    return rules


def organization_rules(name: str = "name") -> list[Rule]:
    return [Rule("ORG_NAME_REQUIRED", ERROR, "Organization name is missing", present(name).isNull())]


def event_rules(title: str = "title", start: str = "start_date", end: str = "end_date") -> list[Rule]:
    return [
        Rule("EVENT_TITLE_REQUIRED", ERROR, "Event title is missing", present(title).isNull()),
        Rule("EVENT_START_DATE_REQUIRED", ERROR, "Event start is missing", F.coalesce(F.col(start), F.lit("")) == ""),
        Rule("EVENT_DATE_VALIDATION", ERROR, "Event ends before it starts", F.coalesce(parse_timestamp(end) <= parse_timestamp(start), F.lit(False))),
    ]


def affiliation_rules(contact: str = "contact_id", organization: str = "organization_id") -> list[Rule]:
    return [
        Rule("AFF_CONTACT_REQUIRED", ERROR, "Contact reference is missing", present(contact).isNull()),
        Rule("AFF_ORGANIZATION_REQUIRED", ERROR, "Organization reference is missing", present(organization).isNull()),
    ]


def with_references(rows: DataFrame, id_map: DataFrame, refs: dict[str, str]) -> DataFrame:
    """rows with _has_<column> for each {column: entity type}: whether an active map entry has that external id.

    One join for each reference; the map is reduced to its distinct active ids first, so rows never multiply.
    """
    for column, kind in refs.items():
        known = id_map.filter(F.col("is_active") & (F.col("entity_type") == kind)).select(F.col("external_id").alias(column), F.lit(True).alias(f"_has_{column}")).distinct()
        rows = rows.join(known, column, "left")
    return rows


def reference_rules(refs: dict[str, str]) -> list[Rule]:
    """Checked only where all references are given."""
    given = F.lit(True)
    for c in refs:
        given = given & present(c).isNotNull()
    return [Rule("AFF_REFERENCE_VALIDATION", ERROR, f"{c} is not known", given & F.col(f"_has_{c}").isNull()) for c in refs]


def judge(rows: DataFrame, rules: list[Rule], warnings_fail: bool = False) -> DataFrame:
    """rows with violations (array of code, severity, message), status and last_error; warnings fail in dry runs only."""
    items = [F.when(r.broken, F.struct(F.lit(r.code).alias("rule_code"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules]
    out = rows.withColumn("violations", F.array_compact(F.array(*items)))
    errors = F.filter("violations", lambda v: v["severity"] == ERROR)
    failed = F.size("violations") > 0 if warnings_fail else F.size(errors) > 0
    return out.withColumns({"status": F.when(failed, "quarantined").otherwise("validated"), "last_error": F.get(errors, F.lit(0))["message"]})


def violation_log(judged: DataFrame, key: Column, entity: str) -> DataFrame:
    """One row for each violation."""
    return judged.select(F.lit(entity).alias("entity_type"), key.alias("record_key"), F.explode("violations").alias("v")).select("entity_type", "record_key", "v.*")


def rule_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"))


def promote(validated: DataFrame, existing: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """Validated rows with their required fields that the clean layer does not hold yet."""
    ok = F.col("status") == "validated"
    for c in required:
        ok = ok & present(c).isNotNull()
    return validated.filter(ok).join(existing.select(*key).distinct(), key, "left_anti")
