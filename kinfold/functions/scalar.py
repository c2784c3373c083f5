"""Scalar normalisers as Column expressions: no UDFs, so all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the rules accept.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
E164_PATTERN = r"^\+[1-9][0-9]{7,14}$"
TRUE_WORDS = ("true", "1", "yes", "y", "on")
FALSE_WORDS = ("false", "0", "no", "n", "off")
CHILD_TO, TEEN_TO, ADULT_TO = 12, 17, 64
SCORE_WEIGHTS = {"name": 0.25, "dob": 0.20, "address": 0.15, "employer": 0.10, "school": 0.10, "alternate_contact": 0.20}
HIGH_BAND, REVIEW_BAND = 0.95, 0.60
GOOD_PERCENT, WARNING_PERCENT = 80, 50


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """The trimmed value, null if blank."""
    return F.nullif(F.trim(column(c)), F.lit(""))


def first_present(*columns: Column | str) -> Column:
    return F.coalesce(*[present(c) for c in columns])


def normalize_email(c: Column | str) -> Column:
    """Trimmed, lower case, without a +tag before the @."""
    return F.regexp_replace(F.lower(present(c)), r"^([^@+]*)\+[^@]*@", "$1@")


def normalize_phone(c: Column | str) -> Column:
    """E.164; ten digits (or eleven from 1) count as North American, extensions go; anything else is null."""
    bare = F.trim(F.regexp_replace(F.trim(column(c)), r"(?is)\s*(x|ext|extension|#)\s*[0-9]+.*$", ""))
    bare = F.regexp_replace(F.translate(bare, " -().", ""), "^00", "+")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    whole = (
        F.when(bare.startswith("+"), F.concat(F.lit("+"), digits))
        .when(F.length(digits) == 10, F.concat(F.lit("+1"), digits))
        .when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))
    )
    return F.when(whole.rlike(E164_PATTERN), whole)


def normalize_name(c: Column | str) -> Column:
    return F.lower(present(c))


def parse_date_text(c: Column | str) -> Column:
    """The first ten characters, unchecked."""
    return F.substring(present(c), 1, 10)


def parse_datetime_text(c: Column | str) -> Column:
    """ISO text with a zone: a Z is appended where neither Z nor + says one (so negative offsets get one too)."""
    t = present(c)
    return F.when(t.endswith("Z") | t.contains("+"), t).otherwise(F.concat(t, F.lit("Z")))


def split_semicolon(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(column(c), ";"), lambda x: F.trim(x)), lambda x: x != "")


def flatten_list(c: Column | str) -> Column:
    """Comma- or semicolon-separated text as a list of non-blank values."""
    return F.filter(F.transform(F.split(F.translate(F.coalesce(column(c), F.lit("")), ";", ","), ","), lambda x: F.trim(x)), lambda x: x != "")


def loose_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(column(c))).isin(*TRUE_WORDS), F.lit(False))


def filter_bool(c: Column | str, default: bool) -> Column:
    """A filter's flag: words that say neither give the default."""
    t = F.lower(F.trim(column(c)))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False).otherwise(default)


def coerce_int(c: Column | str) -> Column:
    """Whole numbers only: text with a fraction is null."""
    t = present(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def parse_timestamp(c: Column | str) -> Column:
    """ISO text to a UTC timestamp, null if it is none."""
    return present(c).try_cast("timestamp")


def parse_birthdate(c: Column | str) -> Column:
    """Texts of ten characters or more by their ISO head, shorter ones as month/day/year, else day/month/year."""
    t = column(c)
    other = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("M/d/yyyy", "d/M/yyyy")]
    return F.when(F.length(t) >= 10, F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(t, 1, 10).try_cast("date"))).otherwise(F.coalesce(*other))


def slugify(c: Column | str, fallback: str = "event") -> Column:
    t = F.regexp_replace(F.lower(column(c)), r"[_\s]+", "-")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\-]", ""), "-+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^-|-$", ""), F.lit("")), F.lit(fallback))


def age(birth: Column | str, as_of: Column) -> Column:
    """Completed years; the day and month count, not the length of months."""
    b = column(birth)
    early = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(b) * 100 + F.dayofmonth(b))
    return F.year(as_of) - F.year(b) - early.cast("int")


def age_group(years: Column) -> Column:
    return F.when(years <= CHILD_TO, "child").when(years <= TEEN_TO, "teen").when(years <= ADULT_TO, "adult").when(years.isNotNull(), "senior")


def full_name(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[present(p) for p in parts])


# How salutations are written out.
SALUTATIONS = {"mr": "Mr.", "mrs": "Mrs.", "ms": "Ms.", "dr": "Dr.", "prof": "Prof."}


def display_name(salutation: Column | str, preferred: Column | str, first: Column | str, last: Column | str) -> Column:
    """The preferred name, or salutation, first and last name."""
    known = F.create_map(*[F.lit(x) for kv in SALUTATIONS.items() for x in kv])
    return F.coalesce(present(preferred), F.concat_ws(" ", F.try_element_at(known, F.lower(F.regexp_replace(present(salutation), r"\.$", ""))), present(first), present(last)))


def full_address(*parts: Column | str) -> Column:
    return F.concat_ws(", ", *[present(p) for p in parts])


def preview(first: Column | str, last: Column | str, email: Column | str, phone: Column | str, ident: Column) -> Column:
    text = F.concat_ws(" · ", F.nullif(full_name(first, last), F.lit("")), present(email), present(phone))
    return F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("Row #"), ident.cast("string")))


def event_end(start: Column, end: Column, minutes: Column) -> Column:
    return F.coalesce(end, F.timestamp_seconds(F.unix_timestamp(start) + minutes * 60))


def duration_minutes(start: Column, end: Column) -> Column:
    """Whole minutes, cut toward zero."""
    return ((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60).cast("long")


def csv_guard(c: Column | str) -> Column:
    """Text that a spreadsheet would run as a formula gets a quote before it."""
    t = column(c)
    return F.when(F.substring(t, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), t)).otherwise(t)


def percent(n: Column, total: Column) -> Column:
    """0 where the total is 0."""
    return F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0))


def rate(n: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(n * 1.0, total), F.lit(0.0))


def status_bucket(pct: Column) -> Column:
    return F.when(pct >= GOOD_PERCENT, "good").when(pct >= WARNING_PERCENT, "warning").otherwise("critical")


def completeness_level(pct: Column) -> Column:
    return F.when(pct >= GOOD_PERCENT, "high").when(pct >= WARNING_PERCENT, "medium").otherwise("low")


def dob_proximity(a: Column, b: Column) -> Column:
    """1 for the same day, 0 from two years apart; 0 if a date is missing."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(F.datediff(a, b)) / F.lit(730.0)), F.lit(0.0))


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))


def weighted_score(features: dict[str, Column]) -> Column:
    return sum((clamped(features[k]) * w for k, w in SCORE_WEIGHTS.items() if k in features), F.lit(0.0))


def exact_name_score(dob: Column, address: Column, alternate: Column) -> Column:
    """The score of pairs with the same name."""
    return F.least(F.lit(1.0), 0.90 + dob * 0.05 + address * 0.03 + alternate * 0.02)


def band(score: Column, high: float = HIGH_BAND, review: float = REVIEW_BAND) -> Column:
    return F.when(score >= high, "high").when(score >= review, "review").otherwise("low")


def alternate_contact(emails_a: Column, phones_a: Column, emails_b: Column, phones_b: Column) -> Column:
    """1 if the two sides share a normalised address or number."""

    def tokens(values: Column, norm) -> Column:
        return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), norm), lambda x: x.isNotNull())

    shared = F.arrays_overlap(tokens(emails_a, normalize_email), tokens(emails_b, normalize_email)) | F.arrays_overlap(tokens(phones_a, normalize_phone), tokens(phones_b, normalize_phone))
    return F.coalesce(shared, F.lit(False)).cast("double")


def record_key(external_id: Column, source_id: Column, sequence: Column, row_id: Column) -> Column:
    return F.coalesce(present(external_id), present(source_id), F.concat(F.lit("seq-"), sequence.cast("string")), F.concat(F.lit("row-"), row_id.cast("string")))


def canonical_json(columns: dict[str, Column]) -> Column:
    """A JSON object with sorted keys that keeps nulls."""
    return F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns)]), {"ignoreNullFields": "false"})


#: Parts of a payload that change with every export, so that a hash over them would never stay the same.
VOLATILE = ("source_modstamp", "source_last_modified")


def payload_hash(columns: dict[str, Column], leave_out: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical JSON, without the fields that are left out (VOLATILE for affiliations)."""
    return F.sha2(canonical_json({n: c for n, c in columns.items() if n not in leave_out}).cast("binary"), 256)


def checksum(columns: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of the fields as text."""
    return payload_hash({n: c.cast("string") for n, c in columns.items()})


def title_case(c: Column | str) -> Column:
    return F.initcap(F.translate(column(c), "_", " "))


def enum_match(c: Column | str, values: tuple[str, ...]) -> Column:
    """The value that equals the text but for case, else null."""
    t = F.lower(F.trim(column(c)))
    return F.coalesce(*[F.when(t == v.lower(), v) for v in values], F.lit(None).cast("string"))


def flag_value(text: Column, kind: Column) -> Column:
    """A stored flag as JSON text by its type tag: boolean, integer, json or string."""
    return F.when(kind == "boolean", loose_bool(text).cast("string")).when(kind == "integer", coerce_int(text).cast("string")).when(kind == "json", text).otherwise(F.to_json(F.struct(text.alias("value"))))


def availability(rows_recurring: Column, start: Column, end: Column, day: Column) -> Column:
    """Whether one active slot of the weekday holds on a day."""
    return F.coalesce((rows_recurring & end.isNull()) | (rows_recurring & day.between(start, end)) | (~rows_recurring & (start == day)), F.lit(False))


def temporal_state(start: Column, end: Column, deadline: Column, now: Column) -> dict[str, Column]:
    """is_past, is_upcoming, is_today and can_register of events at a moment."""
    until = F.coalesce(end, start)
    none = F.lit(False)
    return {
        "is_past": F.coalesce(F.when(start.isNotNull(), until < now), none),
        "is_upcoming": F.coalesce(start > now, none),
        "is_today": F.coalesce((F.to_date(start) == F.to_date(now)) | (F.to_date(until) == F.to_date(now)), none),
        "can_register": F.coalesce(now < F.coalesce(deadline, start), F.lit(True)),
    }


def contactable(do_not_contact: Column, do_not_use: Column) -> Column:
    return ~(F.coalesce(do_not_contact, F.lit(False)) | F.coalesce(do_not_use, F.lit(False)))


def can_contact(method: str, do_not_contact: Column, do_not_use: Column, do_not_email: Column, do_not_call: Column, has_email: Column, has_phone: Column) -> Column:
    """Whether a person may and can be reached by "email" or "phone"; a general refusal wins over all."""
    flag, has = {"email": (do_not_email, has_email), "phone": (do_not_call, has_phone)}[method]
    return contactable(do_not_contact, do_not_use) & ~F.coalesce(flag, F.lit(False)) & F.coalesce(has, F.lit(False))


def in_person(do_not_contact: Column, do_not_use: Column, local: Column) -> Column:
    """Whether a person may be asked to come: contactable and not marked as living elsewhere."""
    return contactable(do_not_contact, do_not_use) & ~local.eqNullSafe(F.lit("non_local"))


def jsonish(c: Column | str) -> Column:
    """Text that spells an object, with double or single quotes, as a map; null for other text."""
    t = present(c)
    return F.when(t.startswith("{"), F.from_json(t, "map<string,string>", {"allowSingleQuotes": "true"}))


def extract_value(c: Column | str, kinds: tuple[str, ...]) -> Column:
    """The first value that is there of an object given as text, else the trimmed text itself."""
    found = jsonish(c)
    return F.when(found.isNotNull(), F.coalesce(*[present(F.try_element_at(found, F.lit(k))) for k in kinds])).otherwise(present(c))


# Kinds of addresses and numbers in the order in which one is picked.
EMAIL_KINDS = ("primary", "home", "work", "alternate")
PHONE_KINDS = ("primary", "mobile", "home", "work")


def extract_email(c: Column | str) -> Column:
    return F.lower(extract_value(c, EMAIL_KINDS))


def extract_phone(c: Column | str) -> Column:
    return extract_value(c, PHONE_KINDS)


def pick_email(emails: dict[str, Column]) -> Column:
    return F.lower(first_present(*[emails[k] for k in EMAIL_KINDS if k in emails]))


def pick_phone(phones: dict[str, Column]) -> Column:
    return first_present(*[phones[k] for k in PHONE_KINDS if k in phones])


def enum_or(c: Column | str, values: tuple[str, ...], default: str | None = None) -> Column:
    """The value that equals the text but for case, else the default; null and blank text stay null without one."""
    return F.coalesce(enum_match(c, values), F.lit(default))


def parse_timestamp_or(c: Column | str, now: Column) -> Column:
    """parse_timestamp, with a given moment for text that is none."""
    return F.coalesce(parse_timestamp(c), now)


def filter_date(c: Column | str, end_of_day: bool = False) -> Column:
    """A filter's bound: ISO date-time, or a date in one of three forms, which as an upper bound means the day's end."""
    t = present(c)
    day = F.coalesce(*[F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form))) for shape, form in (("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), ("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"))])
    if end_of_day:
        day = day + F.expr("interval '23:59:59.999999' hour to second")
    return F.coalesce(day, F.when(t.contains("T") | t.contains(":"), t.try_cast("timestamp")))


def to_list(lists: Column | str | None, text: Column | str | None = None) -> Column:
    """Values of an array column and of separated text as one flat list of non-blank ones."""
    none = F.array().cast("array<string>")
    own = F.coalesce(column(lists), none) if lists is not None else none
    return F.concat(F.filter(F.transform(own, lambda x: F.trim(x)), lambda x: x != ""), flatten_list(text) if text is not None else none)


def duplicate_message(kind: Column, value: Column) -> Column:
    """What a skipped duplicate says."""
    return F.when(kind == "email", F.concat(F.lit("Duplicate email address: "), value)).when(kind == "name", F.concat(F.lit("Duplicate name: "), value)).when(kind == "fuzzy", F.concat(F.lit("Similar name: "), value)).otherwise(F.lit("Duplicate record"))


def compose_notes(department: Column | str, description: Column | str, skills: Column | str) -> Column:
    """A description takes the place of the department's line; skills come after, on a line of their own."""
    head = F.coalesce(present(description), F.concat(F.lit("Department: "), present(department)))
    return F.nullif(F.concat_ws("\n", head, F.concat(F.lit("Skills: "), present(skills))), F.lit(""))


def hours_in_range(day: Column, first: Column, last: Column) -> Column:
    """Whether logged hours count for a range of days; an open end takes all."""
    return F.coalesce(first.isNull() | (day >= first), F.lit(True)) & F.coalesce(last.isNull() | (day <= last), F.lit(True))
