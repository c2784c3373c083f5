"""Declarative field mapping: a specification compiled to one select."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import picklists, scalar

#: Named transforms of a specification.
TRANSFORMS = {
    "parse_date": scalar.parse_date_text,
    "parse_datetime": scalar.parse_datetime_text,
    "split_semicolon": scalar.split_semicolon,
    "normalize_race_ethnicity": picklists.normalize_race_ethnicity,
    "normalize_education_level": picklists.normalize_education_level,
    "normalize_age_group": picklists.normalize_age_group,
    "normalize_organization_type": picklists.normalize_organization_type,
    "normalize_session_type": picklists.normalize_session_type,
    "normalize_session_status": picklists.normalize_session_status,
    "normalize_event_format": picklists.normalize_event_format,
    "normalize_cancellation_reason": picklists.normalize_cancellation_reason,
    "normalize_phone": scalar.normalize_phone,
}


@dataclass(frozen=True)
class FieldMap:
    """One target (a dotted path) from a source column or a default."""

    target: str
    source: str | None = None
    default: str | bool | None = None
    required: bool = False
    transform: str | None = None


@dataclass(frozen=True)
class Spec:
    name: str
    fields: tuple[FieldMap, ...]
    checksum: str = field(default="", compare=False)

    @staticmethod
    def of(name: str, rows: list[dict]) -> Spec:
        """From plain dicts; doubled targets, unknown transforms and fields from nowhere are errors."""
        fields = tuple(FieldMap(**r) for r in rows)
        targets = [f.target for f in fields]
        if len(set(targets)) < len(targets):
            raise ValueError(f"doubled targets: {sorted({t for t in targets if targets.count(t) > 1})}")
        for f in fields:
            if f.source is None and f.default is None:
                raise ValueError(f"{f.target} has neither source nor default")
            if f.transform and f.transform not in TRANSFORMS:
                raise ValueError(f"no transform named {f.transform!r}")
        return Spec(name, fields, hashlib.sha256(json.dumps([name, rows], sort_keys=True).encode()).hexdigest())

    @staticmethod
    def load(text: str) -> Spec:
        """From JSON text {name, fields: [...]}, or the same as YAML where a parser is installed."""
        try:
            body = json.loads(text)
        except ValueError:
            import yaml

            body = yaml.safe_load(text)
        return Spec.of(body["name"], body["fields"])


def named(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_of(f: FieldMap, columns: list[str]) -> Column:
    """Source, else default; then the transform, with the trimmed original where that gives null; flags as booleans."""
    source = scalar.present(named(f.source)) if f.source in columns else F.lit(None).cast("string")
    if isinstance(f.default, bool):
        return scalar.loose_bool(F.coalesce(source, F.lit(str(f.default).lower())))
    text = source if f.default is None else F.coalesce(source, F.lit(f.default))
    if f.transform is None:
        return text
    made = TRANSFORMS[f.transform](text)
    return made if f.transform == "split_semicolon" else F.coalesce(made, text)


def nested(values: list[tuple[list[str], Column]]) -> list[Column]:
    """Structs for dotted paths, in the order in which they first come."""
    groups: dict[str, list] = {}
    for path, value in values:
        groups.setdefault(path[0], []).append((path[1:], value))
    out = []
    for name, inner in groups.items():
        out.append((inner[0][1] if not inner[0][0] else F.struct(*nested(inner))).alias(name))
    return out


def apply_mapping(raw: DataFrame, spec: Spec, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, the mapped targets, errors (required fields without a value) and unmapped (columns no field reads, with values)."""
    mapped = {f.source for f in spec.fields if f.source}
    errors = [F.when(value_of(f, raw.columns).isNull(), F.lit(f"Missing required field: {f.source or f.target}")) for f in spec.fields if f.required]
    extra = [c for c in raw.columns if c not in mapped and c not in keep]
    pairs = [F.when(scalar.present(named(c)).isNotNull(), F.struct(F.lit(c).alias("key"), named(c).cast("string").alias("value"))) for c in extra]
    unmapped = F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.create_map().cast("map<string,string>")
    return raw.select(
        *keep,
        *nested([(f.target.split("."), value_of(f, raw.columns)) for f in spec.fields]),
        (F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")).alias("errors"),
        unmapped.alias("unmapped"),
    )


def field_stats(raw: DataFrame, spec: Spec) -> DataFrame:
    """(source, target, records, populated, defaulted, missing_required, population_rate) in one pass over raw."""
    first: dict[str, FieldMap] = {}
    for f in spec.fields:
        if f.source in raw.columns:
            first.setdefault(f.source, f)  # a source with two targets counts for the first
    aggs = []
    for i, (s, f) in enumerate(first.items()):
        there = scalar.present(named(s)).isNotNull()
        aggs += [F.count_if(there).alias(f"p{i}"), F.count_if(~there & F.lit(f.default is not None)).alias(f"d{i}"), F.count_if(~there & F.lit(f.required and f.default is None)).alias(f"m{i}")]
    one = raw.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = [F.struct(F.lit(s).alias("source"), F.lit(f.target).alias("target"), F.col("n").alias("records"), *[F.col(f"{k}{i}").alias(a) for k, a in (("p", "populated"), ("d", "defaulted"), ("m", "missing_required"))]) for i, (s, f) in enumerate(first.items())]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*", F.round(scalar.rate(F.col("r.populated"), F.col("r.records")), 4).alias("population_rate"))


def unmapped_counts(mapped: DataFrame) -> DataFrame:
    return mapped.select(F.explode(F.map_keys("unmapped")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
