"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.materialize import cut


def number_within(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their number (from 0) within the keys, by the order, whose values should differ within a group.

    Rows are range-partitioned by keys and order, so a group that holds a third of all rows, or all of them (no keys),
    is spread over many tasks; the counts of its parts, one row a part and group, give each part its first number.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "placed")
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", *keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    numbered = placed.withColumn("_local", local.cast("long")).alias("r")
    on = F.col("r._part") == F.col("f._part")
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}"))
    return numbered.join(first.alias("f"), on).select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r._local") + F.col("f._first")).alias(name))
