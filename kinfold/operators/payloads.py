"""Raw payloads as VARIANT: mapped by paths, and what no mapping reads found at any depth.

A path joins the keys of objects by dots; a key that is empty or holds a dot, a bracket or a quote stands as ['key'], and
the items of an array as []. A specification's sources are such paths (an item of an array as [0], [1], ...).

Payloads are JSON texts. One that is null or no JSON (doubled keys are no JSON) has no paths and is flagged as broken
where it isn't null or blank. Values that are null or blank texts count as absent, as do empty objects and arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.mapping import Spec, apply_mapping
from kinfold.operators.materialize import cut


def parsed(raw: DataFrame, text: str, payload: str = "payload") -> DataFrame:
    """raw with the payload of a text column as VARIANT, and whether it is broken."""
    made = raw.withColumn(payload, F.try_parse_json(text))
    given = F.coalesce(F.trim(F.col(text)) != "", F.lit(False))
    return made.withColumn("broken", given & F.col(payload).isNull())


def value_at(payload: str | Column, path: str) -> Column:
    """The value at a path as text; objects and arrays as JSON, null where there is none."""
    return F.try_variant_get(payload, "$" + ("" if path.startswith("[") else ".") + path, "string")


def map_payload(frame: DataFrame, payload: str, spec: Spec, keep: tuple[str, ...] = ()) -> DataFrame:
    """apply_mapping over the values at the paths that the specification's fields read: keep, targets and errors."""
    sources = list(dict.fromkeys(f.source for f in spec.fields if f.source))
    flat = frame.select(*keep, *[value_at(payload, s).alias(s) for s in sources])
    return apply_mapping(flat, spec, keep).drop("unmapped")


def step(parent: Column, key: Column) -> Column:
    """A parent's path (null: the root) with a key, or with [] for an item of an array (a null key)."""
    up = F.coalesce(parent, F.lit(""))
    odd = (key == "") | key.rlike(r"[.\[\]'\"]")
    plain = F.concat(F.when(up != "", F.concat(up, F.lit("."))).otherwise(""), key)
    return F.when(key.isNull(), F.concat(up, F.lit("[]"))).when(odd, F.concat(up, F.lit("['"), key, F.lit("']"))).otherwise(plain)


def general(path: str) -> str:
    """A path with [] for every item of an array."""
    return re.sub(r"\[\d+\]", "[]", path)


def leaves(frame: DataFrame, ident: str, payload: str, read: tuple[str, ...] = ()) -> DataFrame:
    """(ident, path, value) of every value that is neither absent nor at or under one of the paths in `read`.

    A round opens the objects and arrays of one depth by variant_explode, leaves out what is read, and writes what has to
    be opened further, so there are as many rounds as the deepest payload has levels; each row is opened once a level.
    Paths of items are general: reading an item of an array counts as reading all of them.
    """
    done = [general(p) for p in read]
    spark, open_ = frame.sparkSession, frame.select(F.col(ident).alias("_id"), F.lit(None).cast("string").alias("path"), F.col(payload).alias("node"))
    out = spark.createDataFrame([], frame.select(F.col(ident).alias("_id"), F.lit("").alias("path"), F.lit("").alias("value")).schema)
    while True:
        each = open_.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        each = each.select("_id", step(F.col("path"), F.col("key")).alias("path"), F.col("value").alias("node"))
        each = each.filter(~F.col("path").isin(*done)) if done else each
        kind = F.schema_of_variant("node")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        each = cut(each.withColumns({"inner": inner, "value": F.when(~inner, F.trim(F.try_variant_get("node", "$", "string")))}).withColumn("node", F.when(F.col("inner"), F.col("node"))), "paths")
        out = out.unionByName(each.filter("not inner and value <> ''").select("_id", "path", "value"))
        open_ = each.filter("inner").select("_id", "path", "node")
        if open_.isEmpty():
            return out.withColumnRenamed("_id", ident)


def unmapped(frame: DataFrame, ident: str, payload: str, spec: Spec) -> DataFrame:
    """The leaves that no field of a specification reads."""
    return leaves(frame, ident, payload, tuple(f.source for f in spec.fields if f.source))


def path_counts(found: DataFrame, ident: str) -> DataFrame:
    """(path, records, occurrences) of leaves: of how many records, and how many times in all.

    Outside arrays a path comes once in a record at most, so only paths with items need their records told apart.
    """
    items = F.col("path").contains("[]")
    return found.groupBy("path").agg((F.count_if(~items) + F.count_distinct(F.when(items, F.col(ident)))).alias("records"), F.count(F.lit(1)).alias("occurrences"))
