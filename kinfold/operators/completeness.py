"""Field completeness, health and status: one aggregate for an entity, whatever its number of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from kinfold.functions.scalar import percent, status_bucket


def populated(frame: DataFrame, field: str, blank: bool = True, zero: bool = False) -> Column:
    """Whether the field counts as given: not null; with blank, texts not empty; with zero, numbers not 0."""
    kind, c = frame.schema[field].dataType, F.col(field)
    there = c.isNotNull()
    if blank and isinstance(kind, StringType):
        there = there & (c != "")
    if zero and isinstance(kind, NumericType) and not isinstance(kind, BooleanType):
        there = there & (c != 0)
    return there


def field_completeness(frame: DataFrame, fields: list[str], blank: bool = True, zero: bool = False) -> DataFrame:
    """(field, total, populated, percent) from one pass."""
    aggs = [F.count_if(populated(frame, f, blank, zero)).alias(f"_{i}") for i, f in enumerate(fields)]
    one = frame.agg(F.count(F.lit(1)).alias("total"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("populated")) for i, f in enumerate(fields)]))
    out = one.select("total", rows.alias("r")).select("r.field", "total", "r.populated")
    return out.withColumn("percent", F.round(percent(F.col("populated"), F.col("total")), 2))


def relationship_completeness(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(relation, total, populated, percent): parents with at least one child row; each child table is reduced to its keys first."""
    flagged = parents.select(key)
    for name, (child, fk) in children.items():
        flagged = flagged.join(child.select(F.col(fk).alias(key)).distinct().withColumn(f"_{name}", F.lit(1)), key, "left")
    one = flagged.agg(F.count(F.lit(1)).alias("total"), *[F.count(f"_{n}").alias(n) for n in children])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("relation"), F.col(n).alias("populated")) for n in children]))
    out = one.select("total", rows.alias("r")).select("r.relation", "total", "r.populated")
    return out.withColumn("percent", F.round(percent(F.col("populated"), F.col("total")), 2))


def metadata_completeness(maps: DataFrame, column: str, expected: list[str], hidden: tuple[str, ...] = ("payload_hash", "last_payload")) -> DataFrame:
    """(key, populated) of the keys that a map column holds, and of expected ones that it does not."""
    found = maps.select(F.explode(column).alias("key", "value")).filter(F.col("value").isNotNull() & (F.col("value") != "") & ~F.col("key").isin(*hidden))
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("populated"))
    if not expected:
        return counts
    wanted = maps.sparkSession.createDataFrame([(k, 0) for k in expected], "key string, populated long")
    return counts.unionByName(wanted).groupBy("key").agg(F.sum("populated").alias("populated"))


def entity_completeness(fields: DataFrame) -> DataFrame:
    """(entity, total, completeness): the plain mean of rounded percentages, 0 for empty entities; from (entity, field, total, percent)."""
    return fields.groupBy("entity").agg(F.max("total").alias("total"), F.round(F.avg("percent"), 2).alias("completeness"))


def health_score(entities: DataFrame) -> DataFrame:
    """The entities' completeness weighted by their rows."""
    return entities.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("completeness") * F.col("total")), F.sum("total")), F.lit(0.0)), 2).alias("health_score"))


def with_status(fields: DataFrame) -> DataFrame:
    return fields.withColumn("status", status_bucket(percent(F.col("populated"), F.col("total"))))


def enabled(fields: list[str], disabled: set[str]) -> list[str]:
    """Fields that the configuration leaves in, pruned before anything is computed."""
    return [f for f in fields if f not in disabled]


# The fields of each entity that count as its key metrics.
KEY_METRICS = {"contact": ("email", "phone", "address"), "organization": ("email", "phone", "address"), "affiliation": ("contact_id", "organization_id", "is_primary")}


def key_metrics(fields: DataFrame, key: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(entity, metrics: field -> percent) of each entity's key fields; entities without such have all theirs."""
    listed = KEY_METRICS if key is None else key
    wanted = F.lit(False)
    for entity, names in listed.items():
        wanted = wanted | ((F.col("entity") == entity) & F.col("field").isin(*names))
    rows = fields.filter(wanted | ~F.col("entity").isin(*listed))
    return rows.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "percent")))).alias("metrics"))


def link_counts(links: DataFrame) -> DataFrame:
    """Of affiliations: all, those without an end, and primary ones."""
    return links.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("end_date").isNull()).alias("active"), F.count_if(F.coalesce("is_primary", F.lit(False))).alias("primary"))


def checked_config(disabled: dict[str, list[str]], known: dict[str, list[str]]) -> dict[str, set[str]]:
    """A configuration of disabled fields by entity; unknown entities and fields are errors."""
    wrong = [f"{e}.{f}" for e, fields in disabled.items() for f in fields if f not in known.get(e, ())] + [e for e in disabled if e not in known]
    if wrong:
        raise ValueError(f"unknown in the configuration: {wrong}")
    return {e: set(disabled.get(e, ())) for e in known}


def display_config(known: dict[str, list[str]], disabled: dict[str, set[str]]) -> dict[str, list[dict]]:
    """Each entity's fields with a readable name and whether they are shown."""
    return {e: [{"field": f, "label": f.replace("_", " ").title(), "enabled": f not in disabled.get(e, set())} for f in fields] for e, fields in known.items()}
