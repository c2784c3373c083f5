"""Layouts of exported files: violations, metrics, samples, review queue, and a run's artifact."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.sources.sinks import QUEUE_LIMIT, VIOLATION_LIMIT, flattened, guarded

# Columns of the exports in order.
VIOLATION_COLUMNS = ("violation_id", "run_id", "rule_code", "severity", "status", "record_key", "message", "details", "created_at")
METRIC_COLUMNS = ("entity_type", "field_name", "total_records", "records_with_value", "records_without_value", "completeness_percentage", "status")
QUEUE_COLUMNS = ("suggestion_id", "run_id", "primary_id", "candidate_id", "score", "match_type", "decision", "created_at")


def violation_export(violations: DataFrame, limit: int = VIOLATION_LIMIT) -> DataFrame:
    """The newest violations up to the export's limit, details flattened, every text safe in a spreadsheet."""
    rows = violations.withColumn("details", flattened("details")).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"))
    return guarded(rows.select(*VIOLATION_COLUMNS)).orderBy(F.desc("created_at"), F.desc("violation_id")).limit(limit)


def metrics_export(metrics: DataFrame) -> DataFrame:
    """entity, field, total, filled, empty, percentage (two places) and status of every field."""
    rows = metrics.select(
        F.col("entity").alias("entity_type"), F.col("field").alias("field_name"), F.col("total").alias("total_records"), F.col("filled").alias("records_with_value"),
        (F.col("total") - F.col("filled")).alias("records_without_value"), F.round("pct", 2).alias("completeness_percentage"), "status",
    )
    return guarded(rows.select(*METRIC_COLUMNS))


def samples_export(samples: DataFrame, fields: list[str], reasons: str = "reasons") -> DataFrame:
    """Sampled records with their score and the reasons why they are odd, joined by "; "."""
    return guarded(samples.select("entity", "record_id", *fields, F.round("score", 2).alias("score"), F.array_join(reasons, "; ").alias("edge_case_reasons")))


def queue_export(suggestions: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The surest suggestions first, up to the export's limit."""
    return guarded(suggestions.select(*QUEUE_COLUMNS)).orderBy(F.desc_nulls_last("score"), "suggestion_id").limit(limit)


def run_artifact(changes: DataFrame, run_id: int, dry_run: bool) -> DataFrame:
    """One JSON text for a run: its counters, whether anything changed, and how the run differs from a repeat.

    changes: one row with rows_created, rows_updated, rows_reactivated, touched, new and total_active.
    """
    diff = F.when(F.col("rows_created") > 0, "created").when(F.col("rows_updated") + F.col("rows_reactivated") > 0, "updated").otherwise("none")
    body = F.struct(F.lit(run_id).alias("run_id"), F.lit(dry_run).alias("dry_run"), diff.alias("diff"), F.struct(*[c for c in changes.columns]).alias("counts"))
    return changes.select(F.to_json(body).alias("artifact"))


def write_artifact(artifact: DataFrame, path: str) -> dict:
    """Writes the single row as a JSON file beside the run and gives it back."""
    artifact.coalesce(1).write.mode("overwrite").text(path)
    return json.loads(artifact.head()[0])


def truncated(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
