"""Field-level survivorship: which tier's value a field keeps, and what changed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import present

# Tiers from the strongest on, and the groups of fields that they decide.
TIERS = ("manual", "verified_core", "incoming", "existing_core")
GROUPS = {
    "identity": ("first_name", "middle_name", "last_name", "preferred_name"),
    "communication": ("email", "phone_e164"),
    "notes": ("notes", "internal_notes"),
}


@dataclass(frozen=True)
class Profile:
    """Groups of fields and the order of tiers, which a group or a single field may have of its own."""

    groups: dict[str, tuple[str, ...]]
    tiers: tuple[str, ...] = TIERS
    own: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def order(self, name: str | None = None) -> tuple[str, ...]:
        """The tiers of a field, with the two that always exist at the end if they are not named."""
        group = next((g for g, fields in self.groups.items() if name in fields), None)
        tiers = self.own.get(name) or self.own.get(group) or self.tiers
        return (*tiers, *[t for t in ("existing_core", "incoming") if t not in tiers])


def load_profile(text: str) -> Profile:
    """A profile from JSON (or YAML, if that library is there): groups, tiers, and tiers of single groups or fields.

    {"groups": {"identity": ["first_name"]}, "tiers": ["manual", "incoming"], "own": {"first_name": ["existing_core"]}};
    what is missing is as in the default. Unknown tiers and fields in two groups are errors.
    """
    try:
        spec = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        spec = yaml.safe_load(text)
    groups = {g: tuple(f) for g, f in (spec.get("groups") or GROUPS).items()}
    tiers, own = tuple(spec.get("tiers") or TIERS), {k: tuple(v) for k, v in (spec.get("own") or {}).items()}
    fields = [f for g in groups.values() for f in g]
    unknown = [t for t in (*tiers, *[t for o in own.values() for t in o]) if t not in TIERS]
    stray = [k for k in own if k not in groups and k not in fields]
    if unknown or stray or len(set(fields)) < len(fields):
        raise ValueError(f"unknown tiers {unknown}, unknown fields {stray} or a field in two groups")
    return Profile(groups, tiers, own)


DEFAULT = Profile(GROUPS)


def decide(values: dict[str, Column], order: tuple[str, ...]) -> Column:
    """struct(value, tier, changed): the first tier with a non-blank value; changed against the raw existing value."""
    have = [t for t in order if t in values]
    value = F.coalesce(*[present(values[t]) for t in have])
    tier = F.coalesce(*[F.when(present(values[t]).isNotNull(), t) for t in have], F.lit(have[0]))
    existing = values.get("existing_core", F.lit(None).cast("string"))
    return F.struct(value.alias("value"), tier.alias("tier"), (~value.eqNullSafe(existing)).alias("changed"))


def apply_survivorship(rows: DataFrame, profile: Profile = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep and one struct for each field of the profile, from columns <tier>_<field> as far as they exist."""
    out = []
    for fields in profile.groups.values():
        for f in fields:
            values = {t: F.col(f"{t}_{f}") for t in profile.order(f) if f"{t}_{f}" in rows.columns}
            if values:
                out.append(decide(values, profile.order(f)).alias(f))
    return rows.select(*keep, *out)


def decisions(resolved: DataFrame, keep: tuple[str, ...], profile: Profile = DEFAULT) -> DataFrame:
    """One row for each field: keep, group, field, value, tier, changed."""
    rows = [F.struct(F.lit(g).alias("field_group"), F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), F.col(f"{f}.tier").alias("tier"), F.col(f"{f}.changed").alias("changed")) for g, fields in profile.groups.items() for f in fields if f in resolved.columns]
    return resolved.select(*keep, F.explode(F.array(*rows)).alias("d")).select(*keep, "d.*")


def survivorship_stats(made: DataFrame) -> DataFrame:
    """Per group: fields decided, changed, won by hand and by the incoming row (changes only)."""
    won = lambda t: F.count_if((F.col("tier") == t) & F.col("changed"))
    return made.groupBy("field_group").agg(F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("changed"), won("manual").alias("manual_wins"), won("incoming").alias("incoming_overrides"))


def survivorship_totals(made: DataFrame) -> DataFrame:
    """One row: decisions, changes, kept values, wins of each tier and fields that no tier has."""
    won = lambda t: F.count_if((F.col("tier") == t) & F.col("value").isNotNull())
    return made.agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("kept"), won("manual").alias("manual_wins"), won("verified_core").alias("verified_wins"),
        won("incoming").alias("incoming_wins"), won("existing_core").alias("core_wins"), F.count_if(F.col("value").isNull()).alias("empty"),
    )
