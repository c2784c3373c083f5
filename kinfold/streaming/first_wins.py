"""First-wins decisions: of the rows with the same keys within a period (a run's start, a day), the first by an order stays.

`decide` does it for a table, `decide_stream` for a stream, with a state for each bucket of the keys that are open. Both give
(keys, order, period, decision): first, duplicate, unkeyed (a key is null: nothing to share) or undated (no period).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Groups that rows spread over once it is known that they are not the first.
SPREAD = 64
#: Parts of the open keys of a period, each with one state.
BUCKETS = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _narrow(rows: DataFrame, keys: list[str], order: str, period: str) -> DataFrame:
    """Keys as text, the order as a number (null: last) and the period; other columns are joined again by the caller."""
    last = F.lit(2**63 - 1)
    return rows.select(*[F.col(k).cast("string").alias(k) for k in keys], F.coalesce(F.col(order).cast("long"), last).alias(order), F.col(period).cast("timestamp").alias(period))


def _known(keys: list[str], period: str):
    """What a row's own columns decide: null for the rows that must be compared."""
    unkeyed = F.lit(False)
    for k in keys:
        unkeyed = unkeyed | F.col(k).isNull()
    return F.when(unkeyed, "unkeyed").when(F.col(period).isNull(), "undated")


def decide(rows: DataFrame, keys: list[str], order: str, period: str) -> DataFrame:
    """The decisions for a table: an aggregate with partial sums before the shuffle, joined to the rows again.

    Of rows with the same keys, period and order each is called first: give rows different orders.
    """
    narrow = _narrow(rows, keys, order, period).withColumn("_known", _known(keys, period))
    least = narrow.filter(F.col("_known").isNull()).groupBy(*keys, period).agg(F.min(order).alias("_least"))
    decision = F.coalesce("_known", F.when(F.col(order) == F.col("_least"), "first").otherwise("duplicate"))
    return narrow.join(least, [*keys, period], "left").select(*keys, order, period, decision.alias("decision"))


def _behind(keys: list[str], order: str, period: str):
    """A function that marks, in each Arrow batch, rows behind another with the same keys and period.

    Rows with the same period are late together, so a row is never behind one that is dropped as late.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by = b.sort_values(order, kind="stable")
            behind = by.duplicated([*keys, period]).reindex(b.index)
            b["_known"] = b["_known"].astype(object).where(b["_known"].notna(), None)
            b.loc[b["_known"].isna() & behind, "_known"] = "duplicate"
            b["_salt"] = [0 if k is None else i % SPREAD for i, k in enumerate(b["_known"])]
            yield b

    return mark


class FirstWins(StatefulProcessor):
    """Holds the first orders of the open keys of one bucket of a period; a timer forgets them when the watermark reaches it.

    A bucket's state is a list that each batch appends its new keys to, so its reads follow the keys of the buckets that a
    batch touches, not a call for each key.
    """

    def __init__(self, columns: list[str], keys: list[str], order: str):
        self.columns, self.keys, self.order = columns, keys, order

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "keys string")

    def _out(self, rows: pd.DataFrame, decision) -> pd.DataFrame:
        return rows[self.columns].assign(decision=decision)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Rows go through one block at a time; of the keys that are new one row each waits for the end."""
        _bucket, at, known, _salt = key
        if known != "":
            for block in rows:
                yield self._out(block, known)
            return
        held, best = None, None
        for block in rows:
            if not len(block):
                continue
            if held is None:
                held = {tuple(k) for (packed,) in self.held.get() for k in json.loads(packed)}
            named = pd.Series(list(zip(*[block[k] for k in self.keys], strict=True)), index=block.index)
            there = named.map(held.__contains__).astype(bool)
            if there.any():
                yield self._out(block[there], "duplicate")
            waiting = block[~there] if best is None else pd.concat([best, block[~there]], ignore_index=True)
            by = waiting.sort_values(self.order, kind="stable")
            behind = by.duplicated(self.keys)
            if behind.any():
                yield self._out(by[behind], "duplicate")
            best = by[~behind]
        if best is not None and len(best):
            new = list(zip(*[best[k] for k in self.keys], strict=True))
            self.held.appendValue((json.dumps(new),))
            self.handle.registerTimer(int(at))
            yield self._out(best, "first")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def decide_stream(rows: DataFrame, keys: list[str], order: str, period: str, lateness: str) -> DataFrame:
    """The decisions for a stream, each in the batch that brings its row.

    Rows should come in their order (batches of a file one after the other); then any split into batches gives the
    decisions of `decide`. What comes out of order is decided by arrival. A period stays open until the watermark, the
    latest period less the lateness, reaches it; rows of closed periods are dropped and counted (`late_rows`).

    Rows behind another one of their Arrow batch are known to be duplicates before the shuffle and spread over tasks, so a
    key with a third of all rows brings about one row a batch to its state. The keys of a period are dealt into BUCKETS, and
    a bucket costs a few calls between Python and the state store a batch. Needs the state store that `keep_state` sets;
    checkpoints of streams that held a state for each key can't be carried on.
    """
    narrow = _narrow(rows, keys, order, period).withColumn("_known", _known(keys, period)).withColumn("_salt", F.lit(0))
    marked = narrow.mapInPandas(_behind(keys, order, period), narrow.schema)
    columns = [*keys, order, period]
    is_open = F.col("_known").isNull()
    # Decided rows go by their salt alone. No group column is null: pandas would turn a number with nulls into a float.
    bucket = F.when(is_open, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))).otherwise(0).alias("_bucket")
    at = F.when(is_open, F.unix_millis(period)).otherwise(0).alias("_at")
    ready = marked.select(*columns, bucket, at, F.coalesce("_known", F.lit("")).alias("_known"), "_salt").withWatermark(period, lateness)
    out = ", ".join([*[f"`{k}` string" for k in keys], f"`{order}` long", f"`{period}` timestamp", "decision string"])
    return ready.groupBy("_bucket", "_at", "_known", "_salt").transformWithStateInPandas(FirstWins(columns, keys, order), out, "append", "eventTime")


def keep_state(spark: SparkSession) -> None:
    """Sets the state store, on disk with changelogs, that streams with keyed state need; before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def late_rows(stream) -> int:
    """Rows that a stream's recent batches dropped as late."""
    return sum(o["numRowsDroppedByWatermark"] for p in stream.recentProgress for o in p["stateOperators"])
