"""Field statistics that merge: a profile of each part of a table (a file, a day), added up over any parts.

A profile is one row for a part and a field: counts, extremes, the sum, and sketches of the distinct values (HyperLogLog),
of the numbers (KLL) and of the frequent values. Profiles of disjoint parts merge into that of their union, so statistics
of a period read one small row a part and field, not the table. Counts, extremes and sums are exact.

Bounds of the sketches, whatever the number of rows: distinct values have a relative standard error of
1.04 / sqrt(2 ** HLL_BITS), 0.8 %; quantiles are off by at most 1.65 % of the ranks in 99 of 100 cases, and exact up to
KLL_K numbers; counts of frequent values are off by at most 3.5 / TRACKED of the values given, and exact while a field has
fewer than three quarters of TRACKED distinct values. `sampling.field_statistics` is the exact form.

Nulls count as not given and are in no sketch; NaN is a number. A part that is null is a part of its own. Fields without
values, and tables without rows, give nulls for extremes, averages and quantiles. Dates and texts have the extremes of
their text form, numbers those of their value as a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType

from kinfold.operators.mapping import named
from kinfold.sources.run_store import RunStore

HLL_BITS, KLL_K, TRACKED = 14, 200, 3000
EXACT = ("total", "given", "low", "high", "low_number", "high_number", "sum_number")


def _frequent(x: str) -> Column:
    return F.expr(f"approx_top_k_accumulate({x}, {TRACKED}) filter (where {x} is not null)")


def _measures(name: str, kind: DataType, i: int) -> tuple[list[tuple[str, Column]], list[Column]]:
    """The columns that a field's aggregates read, and the aggregates, both numbered by the field's place."""
    value = named(name)
    number = value.cast("double") if isinstance(kind, NumericType) else F.lit(None).cast("double")
    reads = [(f"_t{i}", value.cast("string")), (f"_n{i}", number)]
    if isinstance(kind, IntegralType):
        reads.append((f"_k{i}", value.cast("long")))  # long keys are hashed as they are, others as text
    text, num, key = f"_t{i}", f"_n{i}", reads[-1][0] if len(reads) > 2 else f"_t{i}"
    least, most = (F.min_by(text, num), F.max_by(text, num)) if isinstance(kind, NumericType) else (F.min(text), F.max(text))
    made = {
        "given": F.count(text), "low": least, "high": most, "low_number": F.min(num), "high_number": F.max(num), "sum_number": F.sum(num),
        "distinct_sketch": F.hll_sketch_agg(key, HLL_BITS), "number_sketch": F.kll_sketch_agg_double(num, KLL_K), "frequent_sketch": _frequent(text),
    }
    return reads, [c.alias(f"{n}_{i}") for n, c in made.items()]


SKETCHES = ("distinct_sketch", "number_sketch", "frequent_sketch")


def profile(frame: DataFrame, fields: list[str], part: Column) -> DataFrame:
    """(part, field, total, given, low, high, low_number, high_number, sum_number and the sketches) in one pass over frame.

    Every task adds up its own rows before the shuffle, so a part may hold any share of them; what is shuffled is a few
    kilobytes for each task, part and field.
    """
    kinds = {f.name: f.dataType for f in frame.schema}
    reads, aggs = [part.cast("string").alias("part")], [F.count(F.lit(1)).alias("total")]
    for i, f in enumerate(fields):
        columns, made = _measures(f, kinds[f], i)
        reads += [c.alias(n) for n, c in columns]
        aggs += made
    one = frame.select(*reads).groupBy("part").agg(*aggs)
    names = [n for n in EXACT if n != "total"] + list(SKETCHES)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, f in enumerate(fields)])
    return one.select("part", "total", F.explode(rows).alias("r")).select("part", "r.field", "total", *[f"r.{n}" for n in names])


def merged(profiles: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The profiles of each field as one, over all parts or for each value of `by`."""
    low = F.coalesce(F.min_by("low", "low_number"), F.min("low"))
    high = F.coalesce(F.max_by("high", "high_number"), F.max("high"))
    return profiles.groupBy(*by, "field").agg(
        F.sum("total").alias("total"), F.sum("given").alias("given"), low.alias("low"), high.alias("high"), F.min("low_number").alias("low_number"), F.max("high_number").alias("high_number"),
        F.sum("sum_number").alias("sum_number"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("number_sketch").alias("number_sketch"),
        F.expr("approx_top_k_combine(frequent_sketch)").alias("frequent_sketch"),
    )


def statistics(merged: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 10) -> DataFrame:
    """(field, total, nulls, distinct_estimate, min_value, max_value, avg_value, quantiles, frequent) of merged profiles.

    frequent: structs (value, n), most frequent first, ties by value. Quantiles of fields that are no numbers are null.
    """
    by = [c for c in merged.columns if c not in (*EXACT, *SKETCHES)]
    numbers = F.kll_sketch_get_n_double("number_sketch") > 0
    found = F.transform(F.expr(f"approx_top_k_estimate(frequent_sketch, {top})"), lambda x: F.struct((-x["count"]).alias("less"), x["item"].alias("value")))
    return merged.select(
        *by, "total", (F.col("total") - F.col("given")).alias("nulls"), F.hll_sketch_estimate("distinct_sketch").alias("distinct_estimate"),
        F.col("low").alias("min_value"), F.col("high").alias("max_value"), F.when(F.col("given") > 0, F.round(F.col("sum_number") / F.col("given"), 4)).alias("avg_value"),
        F.when(numbers, F.kll_sketch_get_quantile_double("number_sketch", F.array(*[F.lit(r) for r in ranks]))).alias("quantiles"),
        F.transform(F.array_sort(found), lambda x: F.struct(x["value"], (-x["less"]).alias("n"))).alias("frequent"),
    )


class Profiles:
    """The profiles of a table's parts in a run store: each batch adds those of its own rows, once."""

    def __init__(self, store: RunStore, name: str) -> None:
        self.store, self.name = store, name

    def commit(self, batch: int, rows: DataFrame, fields: list[str], part: Column) -> int:
        """Adds the profiles of a batch of new rows; gives the version. A batch that is there already changes nothing.

        Rows of a part may come in several batches: their profiles merge. Deleted rows can't be taken out of a sketch; a
        part that loses rows has to be profiled again under another name of the store.
        """
        start = self.store.manifest()
        if batch <= start["streams"].get(self.name, -1):
            return start["version"]
        made = profile(rows, fields, part).coalesce(1)  # one row a part and field
        return self.store.commit(self.name, batch, {}, {self.name: made}, start=start)

    def between(self, first: str | None = None, last: str | None = None, version: int | None = None) -> DataFrame:
        """The stored profiles of parts from first to last, as texts, both included; without bounds all, null parts too."""
        rows = self.store.read(self.name, version)
        if first is not None:
            rows = rows.filter(F.col("part") >= first)
        return rows if last is None else rows.filter(F.col("part") <= last)
