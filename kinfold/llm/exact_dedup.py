"""Exact dedup by a heavy-hitter split.

Misra-Gries summaries, one per task and merged, name the digests that may be frequent. An exact second pass verifies
them; those winners (at most `counters` rows, whatever the input) are broadcast and settle the frequent texts without
a shuffle. All other digests, each rarer than rows / (counters + 1), go through an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import WHITE_CLASS, cut, fresh, map_columns

COUNTERS = 1024


def normalised(text: Column) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_CLASS + "+", " ")


def misra_gries(weights: Counter, more: Counter, counters: int) -> Counter:
    """Merge two summaries: add, then take the (counters + 1)-th largest count from all."""
    weights.update(more)
    if len(weights) > counters:
        least = sorted(weights.values(), reverse=True)[counters]
        weights = Counter({k: v - least for k, v in weights.items() if v > least})
    return weights


def frequent_candidates(digests: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` values of the column, with every one that more than rows / (counters + 1) rows hold."""

    def summarise(batches: Iterator[dict]) -> Iterator[dict]:
        kept: Counter = Counter()
        for batch in batches:
            kept = misra_gries(kept, Counter(batch["digest"].to_pylist()), counters)
        yield {"digest": list(kept), "n": list(kept.values())}

    parts = map_columns(digests.select(F.col(column).alias("digest")), summarise, "digest binary, n long")
    summed = parts.groupBy("digest").agg(F.sum("n").alias("n"))
    # Taking the (counters + 1)-th largest count from the sums leaves at most `counters` values.
    top = summed.orderBy(F.desc("n"), "digest").limit(counters + 1)
    least = F.when(F.count(F.lit(1)).over(Window.partitionBy()) > counters, F.min("n").over(Window.partitionBy())).otherwise(0)
    return top.withColumn("least", least).filter("n > least").select("digest").limit(counters)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are (null and "" are). Of equal texts the smallest id stays; of rows
    that repeat that id with that text just one stays. A null id stays only if its group has no other id. Other
    columns of docs, whatever their names, are not read; empty tables give empty results.
    """
    digest = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    # Row numbers are written down once, so that they stay what they are when rows are read again.
    base = cut(docs.select(F.col(id_col).alias("id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    found = frequent_candidates(base, "digest", counters)
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row")).alias("first")
    groups = lambda rows: rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("group_size"))
    winners = cut(groups(base.join(F.broadcast(found), "digest")).filter("group_size > 1"), "winners")  # at most `counters` rows
    split = base.join(F.broadcast(winners), "digest", "left")
    heavy, light = split.filter("group_size is not null"), split.filter("group_size is null").select("digest", "id", "row")
    # A light group may still be large: it is summed up before the shuffle, and the join back can split it.
    both = heavy.unionByName(light.join(groups(light), "digest").select(*heavy.columns))
    return both.select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of docs, with all their columns, that exact_dedup keeps: one for each normalised text.

    Rows are numbered in a written table, so that repeated rows and null ids are told apart; null and empty texts are
    equal to each other; an empty table stays empty.
    """
    row = fresh(docs, "row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    judged = exact_dedup(numbered.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", counters)
    gone = judged.filter(~F.col("kept")).select(F.col("key.row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
