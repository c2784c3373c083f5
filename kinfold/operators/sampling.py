"""Samples by completeness, edge cases and field statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.scalar import completeness_level
from kinfold.operators.completeness import populated

EDGE_SHARE = 0.2


def sample_size(total: int, asked: int | None = None) -> int:
    """What was asked for, within 10 and 50; else all of up to 10 rows, 10 under 100, then ten for each power of ten up to 50."""
    if asked:
        return max(10, min(50, asked))
    if total < 100:
        return min(total, 10)
    return 50 if total >= 1000 else int(10 * math.log10(total))


def with_completeness(frame: DataFrame, fields: list[str], related: tuple[str, ...] = ()) -> DataFrame:
    """frame with score and level: the share of fields and relation flags that are given."""
    flags = [populated(frame, f).cast("int") for f in fields] + [F.col(r).cast("int") for r in related]
    score = sum(flags[1:], flags[0]) * 100.0 / len(flags)
    return frame.withColumn("score", F.round(score, 2)).withColumn("level", completeness_level(F.col("score")))


def edge_reasons(checks: list[tuple[str, Column]]) -> Column:
    """The messages of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for m, c in checks]))


def person_checks(has_email: Column, has_phone: Column, first: Column, last: Column, birth: Column, as_of: Column) -> list[tuple[str, Column]]:
    return [
        ("Missing both email and phone", ~has_email & ~has_phone),
        ("Missing required name fields", (F.coalesce(first, F.lit("")) == "") | (F.coalesce(last, F.lit("")) == "")),
        ("Unusually old birthdate", F.year(birth) < 1900),
        ("Future birthdate", birth > as_of),
    ]


def event_checks(places: list[Column], start: Column, end: Column, as_of: Column) -> list[tuple[str, Column]]:
    nowhere = F.lit(True)
    for p in places:
        nowhere = nowhere & (F.coalesce(p, F.lit("")) == "")
    return [("Missing all location information", nowhere), ("End date before start date", end < start), ("Event over 10 years old", F.datediff(as_of, start) > 3650)]


def volunteer_checks(has_email: Column, has_phone: Column, hours: Column, last: Column, as_of: Column) -> list[tuple[str, Column]]:
    idle = last.isNull() | (F.datediff(as_of, last) > 365)
    return [("Missing both email and phone", ~has_email & ~has_phone), ("High hours but inactive for over a year", (hours > 1000) & idle)]


def low_score(score: Column) -> tuple[str, Column]:
    return ("Low completeness score", score < 50)


def edge_cases(frame: DataFrame, ident: str, limit: int = 20) -> DataFrame:
    """Rows with reasons, most reasons first: a report's top rows."""
    return frame.filter(F.size("reasons") > 0).orderBy(F.size("reasons").desc(), ident).limit(limit)


def seeded(ident: str, seed: int = 0) -> Column:
    """The place of a row in a seeded order, the same in every engine: the MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))))


def stratified(frame: DataFrame, level: str, quotas: dict[str, int], ident: str, seed: int = 0) -> DataFrame:
    """Up to its quota of rows of each level, in an order that the seed and the id fix; other levels give none.

    One read: the limit on the row number makes every task keep its own least rows of each level before the shuffle, so
    what is ranked together is bounded by tasks and quotas. Samples of parts of a table merge: the sample of their union is
    the sample of the whole.
    """
    rows = F.row_number().over(Window.partitionBy(level).orderBy("_place", ident))
    most = max(quotas.values(), default=0)
    ranked = frame.filter(F.col(level).isin(*quotas)).withColumn("_place", seeded(ident, seed)).withColumn("_rn", rows).filter(F.col("_rn") <= most)
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(level) == name, n).otherwise(quota)
    return ranked.filter(F.col("_rn") <= quota).drop("_place", "_rn")


def strata(n: int) -> dict[str, int]:
    """How a sample of n rows is spread over the levels: at least one of each."""
    high, medium = max(1, n * 3 // 10), max(1, n * 4 // 10)
    return {"high": high, "medium": medium, "low": max(1, n - high - medium)}


def sample_report(frame: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """Rows of every level (0.3, 0.4 and 0.3 of n), then edge cases up to a fifth of n as far as there is room; n at most.

    frame has level and reasons (an array, empty for ordinary rows). Both samples are in the seeded order, so a report can
    be made again; is_edge tells which of the sampled rows are edge cases. Ids are unique.
    """
    base = stratified(frame, "level", strata(n), ident, seed).withColumn("_round", F.lit(0))
    odd = frame.filter(F.size("reasons") > 0).withColumn("_all", F.lit("edge"))
    edge = stratified(odd, "_all", {"edge": int(n * EDGE_SHARE)}, ident, seed + 1).drop("_all").withColumn("_round", F.lit(1))
    both = base.unionByName(edge.join(base.select(ident), ident, "left_anti").select(*base.columns))
    cutoff = both.orderBy("_round", F.when(F.col("_round") == 1, seeded(ident, seed + 1)), seeded(ident, seed), ident).limit(n)
    return cutoff.drop("_round").withColumn("is_edge", F.size("reasons") > 0)


def field_samples(frame: DataFrame, field: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that have the field, in a seeded order; unknown fields give none."""
    if field not in frame.columns:
        return frame.limit(0)
    return frame.filter(populated(frame, field)).orderBy(F.xxhash64(F.lit(seed), *frame.columns)).limit(n)


def field_gaps(frame: DataFrame, field: str, ident: str, limit: int) -> DataFrame:
    return frame.filter(~populated(frame, field)).select("*", F.array(F.lit(f"Missing {field}")).alias("reasons")).orderBy(ident).limit(limit)


def field_statistics(frame: DataFrame, fields: list[str]) -> DataFrame:
    """(field, total, nulls, distinct_values, min_value, max_value, avg_value) in one pass; numbers have averages."""
    numeric = {f.name for f in frame.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")}
    aggs = []
    for i, f in enumerate(fields):
        aggs += [F.count(f).alias(f"c{i}"), F.count_distinct(f).alias(f"d{i}"), F.min(f).cast("string").alias(f"l{i}"), F.max(f).cast("string").alias(f"h{i}")]
        aggs.append((F.round(F.avg(f), 4) if f in numeric else F.lit(None).cast("double")).alias(f"a{i}"))
    one = frame.agg(F.count(F.lit(1)).alias("total"), *aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col("total"), (F.col("total") - F.col(f"c{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col(f"l{i}").alias("min_value"), F.col(f"h{i}").alias("max_value"), F.col(f"a{i}").alias("avg_value")) for i, f in enumerate(fields)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def top_values(frame: DataFrame, field: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties by value."""
    return frame.filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(n)


# What a record of each entity is shown by.
SHAPES = {
    "contact": ("person_id", "first_name", "last_name", "email", "phone"),
    "volunteer": ("person_id", "first_name", "last_name", "title", "hours"),
    "student": ("person_id", "first_name", "last_name", "grade", "school"),
    "teacher": ("person_id", "first_name", "last_name", "subject", "school"),
    "event": ("event_id", "title", "description", "start_date", "status"),
    "organization": ("organization_id", "name", "description", "type"),
    "user": ("user_id", "username", "email", "is_active"),
}


def serialized(frame: DataFrame, entity: str, most_text: int = 100) -> DataFrame:
    """(record_id, record): the fields that records of the entity are shown by, as JSON; descriptions are cut short, missing columns null."""
    ident, *fields = SHAPES[entity]
    shown = []
    for f in (ident, *fields):
        c = F.col(f) if f in frame.columns else F.lit(None).cast("string")
        shown.append((F.when(F.length(c) > most_text, F.concat(F.substring(c, 1, most_text), F.lit("..."))).otherwise(c) if f == "description" else c).alias(f))
    return frame.select(F.col(ident).cast("string").alias("record_id"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("record"))


def distribution(frame: DataFrame, field: str, bins: int = 10) -> DataFrame:
    """(bin, n) of a numeric field over equal ranges from its least to its largest value; one value alone is one bin."""
    ends = frame.agg(F.min(field).cast("double").alias("low"), F.max(field).cast("double").alias("high"))
    both = frame.filter(F.col(field).isNotNull()).select(F.col(field).cast("double").alias("x")).join(F.broadcast(ends))  # one row
    place = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int")))
    return both.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
