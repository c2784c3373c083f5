"""Payloads composed of raw and normalised values, and the clean layer of all four entities.

Payloads are maps of text (nested values as JSON text); null maps are empty. A value counts as given if it is not null and
not empty; what is taken is trimmed, and dropped if nothing is left. Normalised values win over raw ones, key by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import present
from kinfold.operators import dq
from kinfold.operators.mapping import named


@dataclass(frozen=True)
class Derived:
    """A key that is made from the first given raw value of `sources`.

    The value is written under the keys of `first` before normalised values come on top; if the key is still not given
    afterwards, under those of `refill`. Without a raw value the first normalised key of `stand_ins` that is there is
    taken, and written under its own keys, unless the key holds a nested value.
    """

    key: str
    sources: tuple[str, ...]
    first: tuple[str, ...]
    refill: tuple[str, ...]
    stand_ins: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _same(key: str, source: str) -> Derived:
    return Derived(key, (source,), (key,), (key,))


# The CRM's names of what each entity's keys are made from.
DERIVED = {
    "volunteer": (
        Derived("email", ("Email",), ("email", "email_normalized"), ("email", "email_normalized"), (("email_normalized", ("email", "email_normalized")), ("VOL_EMAIL", ("email",)))),
        Derived("phone", ("Phone", "MobilePhone", "HomePhone"), ("phone",), ("phone", "phone_e164"), (("phone_e164", ("phone", "phone_e164")), ("VOL_PHONE_E164", ("phone", "phone_e164")), ("VOL_PHONE", ("phone",)))),
    ),
    "organization": (_same("name", "Name"),),
    "affiliation": (_same("contact_external_id", "npe5__Contact__c"), _same("organization_external_id", "npe5__Organization__c")),
    "event": (),
}
#: What clean rows of each entity must have: normalised key and raw name.
REQUIRED = {
    "volunteer": {"first_name": "FirstName", "last_name": "LastName"},
    "organization": {"name": "Name"},
    "affiliation": {"contact_external_id": "npe5__Contact__c", "organization_external_id": "npe5__Organization__c"},
    "event": {"title": "Name"},
}


def whole(payload: str) -> Column:
    return F.coalesce(F.col(payload), F.create_map().cast("map<string,string>"))


def over(lower: Column, upper: Column) -> Column:
    """Both maps as one; the upper one's values win."""
    return F.map_concat(F.map_filter(lower, lambda k, _: ~F.array_contains(F.map_keys(upper), k)), upper)


def given(*values: Column) -> Column:
    """The first value that is not null and not empty, trimmed; null if nothing is left of it."""
    return present(F.coalesce(*[F.nullif(v, F.lit("")) for v in values]))


def _written(keys: tuple[str, ...], value: Column) -> Column:
    entries = F.create_map(*[c for k in keys for c in (F.lit(k), value)])
    return F.when(value.isNotNull(), entries).otherwise(F.create_map().cast("map<string,string>"))


def composed(rows: DataFrame, entity: str, raw: str = "raw", normalized: str = "normalized", payload: str = "payload") -> DataFrame:
    """rows with the payload that rules check and loaders read: raw values, what is derived from them, normalised ones on top.

    Each map is a column of its own, as the next one reads it several times.
    """
    own, high = DERIVED[entity], F.col("_high")
    out = rows.withColumns({"_low": whole(raw), "_high": whole(normalized)})
    out = out.withColumns({f"_v{i}": given(*[F.col("_low")[s] for s in d.sources]) for i, d in enumerate(own)}).withColumn("_p", F.col("_low"))
    for i, d in enumerate(own):
        out = out.withColumn("_add", _written(d.first, F.col(f"_v{i}"))).withColumn("_p", over(F.col("_p"), F.col("_add")))
    out = out.withColumn("_p", over(F.col("_p"), high))
    for i, d in enumerate(own):
        value, now = F.col(f"_v{i}"), F.col("_p")[d.key]
        added = _written(d.refill, F.when(F.coalesce(now, F.lit("")) == "", value))
        for key, keys in reversed(d.stand_ins):
            there = value.isNull() & F.array_contains(F.map_keys(high), key) & ~F.coalesce(now.startswith("{"), F.lit(False))
            added = F.when(there, _written(keys, present(high[key]))).otherwise(added)
        out = out.withColumn("_add", added).withColumn("_p", over(F.col("_p"), F.col("_add")))
    return out.select(*[named(c) for c in rows.columns], F.col("_p").alias(payload))


def clean_candidates(judged: DataFrame, entity: str, raw: str = "raw", normalized: str = "normalized") -> DataFrame:
    """judged with external_system, external_id, the required values (null where not given) and the clean payload."""
    low, high = whole(raw), whole(normalized)
    needed = {k: given(high[k], low[s]) for k, s in REQUIRED[entity].items()}
    entries = F.create_map(*[c for k, v in needed.items() for c in (F.lit(k), v)])
    return judged.withColumns({
        "external_system": F.coalesce(given(high["external_system"], low["external_system"]), F.col("external_system")),
        "external_id": given(high["external_id"], low["external_id"], F.col("external_id").cast("string")),
        **needed,
        "payload": over(high, entries),
    })


def clean_entities(judged: DataFrame, entity: str, existing: DataFrame, key: str) -> DataFrame:
    """The validated rows of an entity that have what they must and are not in the clean layer yet.

    judged: key, status, external_system, external_id, raw, normalized. existing: key of the rows that were promoted.
    """
    rows = clean_candidates(judged, entity)
    return dq.promote(rows, existing, [key], list(REQUIRED[entity])).select(key, "external_system", "external_id", *REQUIRED[entity], "payload")


def promotion_counts(judged: DataFrame, promoted: DataFrame) -> DataFrame:
    """One row: rows considered (validated), promoted and skipped."""
    both = judged.agg(F.count_if(F.col("status") == "validated").alias("considered")).join(F.broadcast(promoted.agg(F.count(F.lit(1)).alias("promoted"))))  # one row each
    return both.withColumn("skipped", F.col("considered") - F.col("promoted"))
