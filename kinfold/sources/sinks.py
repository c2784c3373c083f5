"""File sinks: guarded CSV exports, JSON lines and run folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import csv_guard

VIOLATION_LIMIT, QUEUE_LIMIT = 5000, 10_000


def guarded(rows: DataFrame) -> DataFrame:
    """Every text column safe to open in a spreadsheet."""
    return rows.select(*[csv_guard(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in rows.schema])


def flattened(details: str) -> F.Column:
    """A map column as k=v; k=v with sorted keys."""
    entries = F.array_sort(F.map_entries(details))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"], F.lit("")))), "; ")


def write_csv(rows: DataFrame, path: str, limit: int | None = None) -> None:
    (guarded(rows) if limit is None else guarded(rows).limit(limit)).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_run(rows: DataFrame, path: str) -> None:
    """Rows of one run into a table that is split by run."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)
