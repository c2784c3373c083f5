"""Picklist normalisers compiled to one expression each: direct lookup, then the first key that contains the text or is in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.scalar import normalize_name

# Fixed values: (value, its keys), in the order in which partial matches are tried.
RACE = [
    ("prefer_not_to_say", ["prefer not to answer", "prefer not to say", "prefer_not_to_say", "prefer not to respond"]),
    ("black_or_african_american", ["black", "black/african american", "african american", "african-american", "black_or_african_american"]),
    ("white", ["white", "caucasian", "white/caucasian", "white/caucasian/european american", "european american"]),
    ("asian", ["asian", "asian american", "asian/pacific islander"]),
    ("hispanic_or_latino", ["hispanic", "latino", "latina", "hispanic or latino", "hispanic/latino", "hispanic_or_latino"]),
    ("native_american", ["native american", "american indian", "native american/american indian", "native_american"]),
    ("pacific_islander", ["pacific islander", "pacific_islander"]),
    ("two_or_more", ["bi-racial", "multi-racial", "multiracial", "bi-racial/multi-racial/multicultural white/caucasian/european american", "bi-racial/multi-racial", "two or more", "two_or_more", "mixed", "multicultural"]),
    ("other", ["other"]),
]
EDUCATION = [
    ("less_than_high_school", ["less than high school", "less than hs", "no high school", "elementary school", "middle school", "less_than_high_school"]),
    ("high_school", ["high school", "high school diploma", "high school graduate", "hs diploma", "ged", "general equivalency diploma", "high_school"]),
    ("some_college", ["some college", "some college credit", "college credit", "attended college", "some_college"]),
    ("associates", ["associate's", "associates", "associate degree", "associate's degree", "aa", "a.a.", "as", "a.s.", "aas"]),
    ("bachelors", ["bachelor's", "bachelor", "bachelors", "bachelor's degree", "bachelor degree", "ba", "b.a.", "bs", "b.s.", "bsba", "bsc"]),
    ("masters", ["master's", "masters", "master", "master's degree", "master degree", "ma", "m.a.", "ms", "m.s.", "msc", "mba"]),
    ("doctorate", ["doctorate", "doctorate degree", "phd", "ph.d.", "ph.d", "d.phil", "ed.d.", "edd", "doctoral degree"]),
    ("professional", ["professional", "professional degree", "jd", "j.d.", "law degree", "md", "m.d.", "medical degree"]),
    ("other", ["other", "not specified", "prefer not to answer"]),
]
AGE = [
    ("child", ["child"]),
    ("teen", ["teen"]),
    ("adult", ["adult"]),
    ("senior", ["senior"]),
    ("child", ["0-12", "0-12 years", "under 13", "12 and under"]),
    ("teen", ["13-17", "13-17 years", "teenager", "teens"]),
    ("adult", ["18-64", "18-64 years", "adults"]),
    ("senior", ["65+", "65 and over", "65 and older", "over 65", "seniors", "elderly", "60-69", "60-69 years", "70-79", "70-79 years", "80+", "80 and over"]),
]
ORGANIZATION_TYPE = [
    ("school", ["school", "elementary school", "middle school", "high school", "school district", "educational institution", "university", "college"]),
    ("business", ["business", "company", "corporation", "corp", "llc", "partnership", "for-profit", "for profit", "commercial"]),
    ("non_profit", ["non-profit", "nonprofit", "non profit", "non_profit", "501(c)(3)", "501c3", "charity", "foundation", "ngo"]),
    ("government", ["government", "federal", "state", "local government", "municipal", "city", "county", "public sector"]),
    ("other", ["other", "unknown"]),
]
SESSION_TYPE = [
    ("community_event", ["campus visit", "campus", "career speaker", "career speakers", "speaker", "workplace visit", "workplace", "healthstart", "health start", "bfi", "career fair", "careerfair"]),
    ("workshop", ["workshop", "workshops"]),
    ("meeting", ["meeting", "meetings"]),
    ("training", ["training", "trainings"]),
    ("fundraiser", ["fundraiser", "fundraisers", "fund raising"]),
    ("other", ["other"]),
]
SESSION_STATUS = [
    ("draft", ["draft"]),
    ("requested", ["requested"]),
    ("confirmed", ["confirmed"]),
    ("completed", ["completed", "complete"]),
    ("cancelled", ["cancelled", "canceled", "cancellation"]),
]
EVENT_FORMAT = [
    ("in_person", ["in-person", "in person", "in_person"]),
    ("virtual", ["virtual", "online", "remote"]),
    ("hybrid", ["hybrid"]),
]
CANCELLATION = [
    ("weather", ["weather"]),
    ("low_attendance", ["low attendance", "low_attendance"]),
    ("emergency", ["emergency"]),
    ("scheduling_conflict", ["scheduling conflict", "scheduling_conflict", "conflict"]),
    ("other", ["other"]),
]


def keys_of(table: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """(key, value) in order."""
    return [(k, v) for v, keys in table for k in keys]


def lookup(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in keys_of(table) for x in (k, v)])[text]


def partly(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The value of the first key in the text, or with the text in it: one constant list, searched in order."""
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in keys_of(table)])
    return F.get(F.filter(keys, lambda e: text.contains(e["k"]) | e["k"].contains(text)), F.lit(0))["v"]


def normalizer(table: list[tuple[str, list[str]]], default: str | None = None):
    def apply(c: Column | str) -> Column:
        text = normalize_name(c)
        return F.when(text.isNotNull(), F.coalesce(lookup(text, table), partly(text, table), F.lit(default)))

    return apply


def normalize_age_group(c: Column | str) -> Column:
    """Lookup, then a range a-b, then n+, then partial keys."""
    text = normalize_name(c)
    low = F.regexp_extract(text, r"([0-9]+)\s*-\s*([0-9]+)", 1).try_cast("int")
    high = F.regexp_extract(text, r"([0-9]+)\s*-\s*([0-9]+)", 2).try_cast("int")
    plus = F.regexp_extract(text, r"([0-9]+)\s*\+", 1).try_cast("int")
    ranged = (
        F.when(high <= 12, "child")
        .when((low >= 13) & (high <= 17), "teen")
        .when((low >= 18) & (high <= 64), "adult")
        .when(low >= 65, "senior")
        .when((low < 13) & (high > 17), "teen")
        .when((low < 18) & (high > 64), "adult")
        .when(low < 65, "senior")
    )
    from_on = F.when(plus >= 65, "senior").when(plus >= 18, "adult").when(plus >= 13, "teen").when(plus.isNotNull(), "child")
    return F.when(text.isNotNull(), F.coalesce(lookup(text, AGE), ranged, from_on, partly(text, AGE)))


normalize_race_ethnicity = normalizer(RACE)
normalize_education_level = normalizer(EDUCATION)
normalize_organization_type = normalizer(ORGANIZATION_TYPE, "other")
normalize_session_type = normalizer(SESSION_TYPE, "other")
normalize_session_status = normalizer(SESSION_STATUS, "requested")
normalize_event_format = normalizer(EVENT_FORMAT, "in_person")
normalize_cancellation_reason = normalizer(CANCELLATION, "other")
