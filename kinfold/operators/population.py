"""Field completeness kept by deltas: stored counts of rows and of given fields, to which each batch of changes is added.

A change log holds images of rows with a sign: +1 for an inserted row and the new image of an updated one, -1 for a
deleted row and the old image of an updated one. A commit aggregates the log of its batch, in which Spark sums before the
shuffle, and adds the few sums to the stored ones; the tables themselves are not read. Null signs count as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import percent
from kinfold.operators.completeness import populated
from kinfold.sources.run_store import RunStore

COUNTS = "entity string, field string, total long, populated long"
KEYS = "entity string, key string, populated long"


def changes(before: DataFrame, after: DataFrame, sign: str = "sign") -> DataFrame:
    """A change log from the old images (of updated and deleted rows) and the new ones (of inserted and updated rows)."""
    return after.withColumn(sign, F.lit(1)).unionByName(before.withColumn(sign, F.lit(-1)))


def field_delta(log: DataFrame, entity: str, fields: list[str], sign: str = "sign", blank: bool = True, zero: bool = False) -> DataFrame:
    """What a log adds to the counts of an entity's fields, in one pass over it; no rows give zeros."""
    s = F.coalesce(F.col(sign).cast("long"), F.lit(0))
    sums = [F.coalesce(F.sum(F.when(populated(log, f, blank, zero), s)), F.lit(0)).alias(f"_{i}") for i, f in enumerate(fields)]
    one = log.agg(F.coalesce(F.sum(s), F.lit(0)).alias("total"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{i}").alias("populated")) for i, f in enumerate(fields)]))
    return one.select("total", rows.alias("r")).select(F.lit(entity).alias("entity"), "r.field", "total", "r.populated")


def key_delta(log: DataFrame, entity: str, column: str, sign: str = "sign", hidden: tuple[str, ...] = ("payload_hash", "last_payload")) -> DataFrame:
    """What a log adds to the counts of the keys that a map column gives a value for."""
    given = log.select(F.explode(column).alias("key", "value"), F.coalesce(F.col(sign).cast("long"), F.lit(0)).alias("s"))
    kept = given.filter(F.col("value").isNotNull() & (F.col("value") != "") & ~F.col("key").isin(*hidden))
    return kept.groupBy("key").agg(F.sum("s").alias("populated")).select(F.lit(entity).alias("entity"), "key", "populated")


def added(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored sums and a delta as one table of sums, whichever of both a row is in."""
    sums = [c for c in ("total", "populated") if c in stored.columns]
    names = [c for c in stored.columns if c not in sums]
    return stored.unionByName(delta).groupBy(*names).agg(*[F.sum(c).alias(c) for c in sums]).select(*stored.columns)


class Population:
    """The counts of all entities in a run store, each batch of changes added once."""

    def __init__(self, store: RunStore, name: str = "population"):
        self.store, self.name = store, name

    def commit(self, batch: int, logs: dict[str, tuple[DataFrame, list[str]]], maps: dict[str, tuple[DataFrame, str]] | None = None, zero: bool = False) -> int:
        """Adds entity -> (log, fields) and entity -> (log, map column); a batch that was committed before changes nothing.

        The counts and the number of the batch become visible in one step. Numbers of batches ascend.
        """
        start = self.store.manifest()
        if batch <= start["streams"].get(self.name, -1):
            return start["version"]
        fields, keys = self.fields(start["version"]), self.keys(start["version"])
        for entity, (log, names) in logs.items():
            fields = added(fields, field_delta(log, entity, names, zero=zero))
        for entity, (log, column) in (maps or {}).items():
            keys = added(keys, key_delta(log, entity, column)).filter(F.col("populated") != 0)
        tables = {self.name: fields.coalesce(1), f"{self.name}_keys": keys.coalesce(1)}  # one row a field or key
        return self.store.commit(self.name, batch, tables, start=start)

    def _read(self, name: str, schema: str, version: int | None) -> DataFrame:
        return self.store.read(name, version or None, empty=schema)

    def fields(self, version: int | None = None) -> DataFrame:
        return self._read(self.name, COUNTS, version)

    def keys(self, version: int | None = None) -> DataFrame:
        """(entity, key, populated): keys that no row holds any more are gone."""
        return self._read(f"{self.name}_keys", KEYS, version)

    def completeness(self, version: int | None = None) -> DataFrame:
        """(entity, field, total, populated, percent), as a count over the tables gives it; what entity and health scores read."""
        return self.fields(version).withColumn("percent", F.round(percent(F.col("populated"), F.col("total")), 2))
