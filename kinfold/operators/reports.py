"""Run, violation, skip, queue and activity statistics, and sorted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import age, age_group, rate


def counts_by_each(frame: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) of every dimension from one grouping-sets pass."""
    sets = frame.groupingSets([[d] for d in dimensions], *dimensions).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    width = len(dimensions)
    name = F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0, d) for i, d in enumerate(dimensions)])
    value = F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (width - 1 - i)) == 0, F.col(d).cast("string")) for i, d in enumerate(dimensions)])
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def counts_of_known(frame: DataFrame, column: str, known: tuple) -> DataFrame:
    """(column, n) of every known value, zero where no row has it; other values don't count."""
    values = F.explode(F.array(*[F.lit(k) for k in known])).alias(column)
    counts = frame.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return frame.sparkSession.range(1).select(values).join(counts, column, "left").fillna(0, ["n"])


def reason_prefix(reason: Column) -> Column:
    """What stands before the first colon, else the first fifty characters."""
    return F.when(reason.contains(":"), F.trim(F.substring_index(reason, ":", 1))).otherwise(F.substring(reason, 1, 50))


def skip_summary(skips: DataFrame) -> DataFrame:
    """(skip_type, reason, n); blank reasons are one group."""
    r = F.when(F.coalesce("skip_reason", F.lit("")) != "", reason_prefix(F.col("skip_reason")))
    return skips.groupBy("skip_type", r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def remediation_stats(violations: DataFrame, since: Column) -> DataFrame:
    """(field, outcome, rule_code, n) of edits after a moment, from audits: array of (at, outcome, rule_codes, diff map)."""
    events = violations.select("rule_code", F.explode("audit").alias("a")).filter(F.col("a.at") >= since)
    rules = F.when(F.col("a.outcome") == "success", F.array("rule_code")).otherwise(F.col("a.rule_codes"))
    return events.select(F.explode(F.map_keys("a.diff")).alias("field"), F.col("a.outcome").alias("outcome"), rules.alias("rules")).select("field", "outcome", F.explode("rules").alias("rule_code")).groupBy("field", "outcome", "rule_code").agg(F.count(F.lit(1)).alias("n"))


def hours_by(hours: DataFrame, owner: str) -> DataFrame:
    """hours, sessions, first and last day of each owner."""
    return hours.groupBy(owner).agg(F.coalesce(F.sum("hours"), F.lit(0.0)).alias("hours"), F.count(F.lit(1)).alias("sessions"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def total_hours(people: DataFrame, hours: DataFrame, owner: str) -> DataFrame:
    """people with total_hours written again from the log of hours: 0 for those without any, null hours left out."""
    sums = hours.groupBy(owner).agg(F.sum(F.col("hours").cast("double")).alias("_sum"))
    return people.join(sums, owner, "left").withColumn("total_hours", F.coalesce("_sum", F.lit(0.0))).drop("_sum")


def age_groups(people: DataFrame, birth: str, as_of: Column) -> DataFrame:
    """people with age_group written again from their birthdates as of a day; null without one."""
    return people.withColumn("age_group", age_group(age(birth, as_of)))


def match_quality(staged: DataFrame, clean: DataFrame, skips: DataFrame) -> DataFrame:
    """Per run and over all (run_id null): attempted (the larger of staged and clean), skipped, matched and match_rate."""
    part = lambda f, name: f.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    runs = part(staged, "staged").join(part(clean, "clean"), "run_id", "full_outer").join(part(skips, "skipped"), "run_id", "left").fillna(0, ["staged", "clean", "skipped"])
    per = runs.select("run_id", F.greatest("staged", "clean").alias("attempted"), "skipped").withColumn("matched", F.col("attempted") - F.col("skipped"))
    whole = per.agg(*[F.sum(c).alias(c) for c in ("attempted", "skipped", "matched")]).select(F.lit(None).cast(per.schema["run_id"].dataType).alias("run_id"), "attempted", "skipped", "matched")
    return per.unionByName(whole).withColumn("match_rate", F.round(rate(F.col("matched"), F.col("attempted")), 4))


def id_map_changes(id_map: DataFrame, run_id: Column, examples: int = 5) -> DataFrame:
    """Entries that a run touched, those it made (first seen = last seen), all active ones, and a few ids of the new."""
    touched = F.col("run_id") == run_id
    new = touched & (F.col("first_seen_at") == F.col("last_seen_at"))
    counts = id_map.agg(F.count_if(touched).alias("touched"), F.count_if(new).alias("new"), F.count_if("is_active").alias("total_active"))
    some = id_map.filter(new).orderBy("external_id").limit(examples).agg(F.array_sort(F.collect_list("external_id")).alias("examples"))
    return counts.join(F.broadcast(some))  # one row each


def sorted_page(frame: DataFrame, sort: str, allowed: dict[str, str | tuple[str, ...]], ident: str, page: int, size: int, most: int = 100) -> DataFrame:
    """A page of rows by a whitelisted field ("-field": descending), which may stand for several columns, the id as tiebreak."""
    name, down = sort.removeprefix("-"), sort.startswith("-")
    if name not in allowed:
        raise ValueError(f"can't sort by {name!r}")
    size = max(1, min(most, size))
    columns = allowed[name] if isinstance(allowed[name], tuple) else (allowed[name],)
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c in columns]
    return frame.orderBy(*order, ident).offset((max(1, page) - 1) * size).limit(size)


def latest(frame: DataFrame, stamp: str, ident: str, n: int) -> DataFrame:
    """The n newest rows, for lists of runs and logs."""
    return frame.orderBy(F.desc_nulls_last(stamp), F.desc(ident)).limit(n)


def page_count(total: int, size: int) -> int:
    return -(-total // size)


def high_water(frame: DataFrame, stamp: str) -> DataFrame:
    return frame.agg(F.max(stamp).alias("high_water"))


def distinct_values(frame: DataFrame, field: str) -> DataFrame:
    return frame.filter(F.trim(field) != "").select(field).distinct().orderBy(field)


def recent_counts(users: DataFrame, as_of: Column) -> DataFrame:
    """Users in all, active, made within 30 days and seen within 7."""
    return users.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(F.col("created_at") >= as_of - F.expr("interval 30 days")).alias("recent"), F.count_if(F.col("last_login") >= as_of - F.expr("interval 7 days")).alias("logins"))
