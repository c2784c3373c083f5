"""Loading CRM records: what each record does to the core, and the tables that follow from it.

Contacts, organizations, events and affiliations share one plan: a record's map entry and the hash of its payload decide
between create, update and delete; what is created is then looked up among what is there. Rows are taken in order, so a
record sees what earlier ones of the run created; that is settled with first-row-of-a-key aggregates, not row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import picklists
from kinfold.functions.scalar import EMAIL_PATTERN, compose_notes, duration_minutes, enum_match, loose_bool, normalize_phone, parse_timestamp, present, slugify
from kinfold.operators.load import unique_slugs
from kinfold.operators.materialize import cut

# Kinds of values in the order in which they are taken, and what they are stored as.
EMAIL_KINDS = {"primary": "personal", "home": "personal", "work": "work", "alternate": "other"}
PHONE_KINDS = {"primary": "mobile", "mobile": "mobile", "home": "home", "work": "work", "other": "other"}
ADDRESS_KINDS = ("mailing", "home", "work", "other")
EVENT_LINKS = {"district_id": True, "school_id": False, "parent_account_id": False}
COUNTERS = {"created": ("inserted",), "updated": ("updated",), "unchanged": ("no_change", "unchanged", "skipped_duplicate"), "deleted": ("deleted",), "skipped": ("skipped",)}


def staged(records: DataFrame, run_id: int, entity: str, order: str) -> DataFrame:
    """CRM records as staging rows of a run: numbered, with a status, and for contacts and sessions what is derived from them.

    Contacts without any address and number are marked; sessions get their duration in minutes.
    """
    from kinfold.operators.ranking import number_within

    rows = number_within(records, [], [order], "sequence_number").withColumns({"run_id": F.lit(run_id), "sequence_number": F.col("sequence_number") + 1, "status": F.lit("landed")})
    if entity == "contact":
        rows = rows.withColumn("missing_contact_info", present("email").isNull() & present("phone").isNull())
    if entity == "session":
        rows = rows.withColumn("duration", duration_minutes(parse_timestamp("start_date"), parse_timestamp("end_date")))
    return rows


def staging_stats(rows: DataFrame, marked: str | None = None) -> DataFrame:
    """Rows staged, the latest stamp, and how many rows carry the mark."""
    return rows.agg(F.count(F.lit(1)).alias("rows_staged"), F.max("modstamp").alias("max_modstamp"), (F.count_if(marked) if marked else F.lit(0).cast("long")).alias("marked"))


def routes(incoming: DataFrame, id_map: DataFrame, entity: str, live: DataFrame) -> DataFrame:
    """incoming with route (none, delete, create, update), entity_id, is_active and old_hash of its map entry.

    incoming: external_id, hash, deleted. Map entries whose record is not in `live` (entity_id) any more lead to create.
    """
    own = id_map.filter(F.col("entity_type") == entity).select("external_id", "entity_id", "is_active", F.col("hash").alias("old_hash"))
    there = live.select("entity_id", F.lit(True).alias("_there")).distinct()
    both = incoming.join(own.join(there, "entity_id", "left"), "external_id", "left")
    route = (
        F.when(present("external_id").isNull(), "none").when(F.coalesce("deleted", F.lit(False)), "delete").when(F.col("_there"), "update").otherwise("create")
    )
    return both.withColumn("route", route).drop("_there")


def deletion(entity_id: Column, is_active: Column) -> Column:
    """A record that is gone upstream: unknown ones count as deleted, inactive entries stay as they are."""
    return F.when(entity_id.isNotNull() & ~is_active, "unchanged").otherwise("deleted")


def change(old_hash: Column, new_hash: Column) -> Column:
    return F.when(old_hash == new_hash, "no_change").otherwise("updated")


def fixed_actions(routed: DataFrame) -> Column:
    """The action of all routes but create."""
    return (
        F.when(F.col("route") == "none", "unchanged")
        .when(F.col("route") == "delete", deletion(F.col("entity_id"), F.col("is_active")))
        .when(F.col("route") == "update", change(F.col("old_hash"), F.col("hash")))
    )


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order of its first row)."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))


def organizations(incoming: DataFrame, id_map: DataFrame, core: DataFrame) -> DataFrame:
    """incoming (seq, external_id, hash, deleted, name, type) with load_action, skip_type, entity_id and the name it is a double of.

    A new record needs a name; one whose name (in any case) the core or an earlier new record has is linked to it.
    core: entity_id, name. Inserted records have no entity id yet; linked ones name their model in `twin`.
    """
    routed = routes(incoming, id_map, "organization", core).withColumn("key", F.lower(present("name")))
    known = core.groupBy(F.lower(present("name")).alias("key")).agg(F.min("entity_id").alias("known_id"))
    new = routed.filter("route = 'create'")
    firsts = first_of(new, "key", "seq").withColumnRenamed("_first", "first_seq")
    joined = routed.join(known, "key", "left").join(firsts, "key", "left")
    double = F.col("known_id").isNotNull() | (F.col("seq") > F.col("first_seq"))
    created = F.when(F.col("key").isNull(), "unchanged").when(double, "skipped_duplicate").otherwise("inserted")
    action = F.coalesce(fixed_actions(joined), created)
    skip = F.when((F.col("route") == "create") & F.col("key").isNull(), "MISSING_REQUIRED_FIELD").when((F.col("route") == "create") & double, "DUPLICATE_NAME")
    return joined.select(
        *incoming.columns, action.alias("load_action"), skip.alias("skip_type"),
        F.when(F.col("route") == "create", F.col("known_id")).otherwise(F.col("entity_id")).alias("entity_id"),
        F.when(skip == "DUPLICATE_NAME", F.col("key")).alias("twin"),
    )


def organization_rows(decided: DataFrame, taken: DataFrame) -> DataFrame:
    """What inserted organizations are stored as: name, a slug of their own, type, active."""
    new = decided.filter("load_action = 'inserted'").select("seq", "external_id", "name", picklists.normalize_organization_type("type").alias("organization_type"), slugify("name", "organization").alias("base"))
    return unique_slugs(new, "base", "seq", taken).drop("base").withColumn("is_active", F.lit(True))


def link_note(run_id: int, external_id: Column) -> Column:
    return F.concat(F.lit(f"Linked from CRM import (run {run_id}, external_id: "), external_id, F.lit(")"))


def linked_notes(core: DataFrame, decided: DataFrame, run_id: int) -> DataFrame:
    """core (entity_id, description) with a note for each record that was linked to it, unless it is there already."""
    notes = decided.filter("skip_type = 'DUPLICATE_NAME' and entity_id is not null").groupBy("entity_id").agg(F.array_sort(F.collect_set(link_note(run_id, F.col("external_id")))).alias("_notes"))
    both = core.join(notes, "entity_id", "left")
    new = F.filter(F.coalesce("_notes", F.array().cast("array<string>")), lambda n: ~F.coalesce(F.col("description").contains(n), F.lit(False)))
    own = F.nullif("description", F.lit(""))
    return both.withColumn("description", F.when(F.size(new) > 0, F.concat_ws("\n\n", own, F.array_join(new, "\n\n"))).otherwise(own)).drop("_notes")


def contacts(incoming: DataFrame, id_map: DataFrame, core: DataFrame, core_mails: DataFrame) -> DataFrame:
    """incoming (seq, external_id, hash, deleted, mail, name) with load_action, skip_type and entity_id.

    A new record whose address anybody has is a double; else one whose whole name the core has is linked to that person
    and gives it the address. core: entity_id, name; core_mails: mail. Among new records the first of an address or a
    name is inserted and the later ones are doubles of it; that needs rounds where a row's address and name meet different rows.
    """
    routed = cut(routes(incoming, id_map, "contact", core), "routed")
    waiting = routed.filter("route = 'create'").select("seq", "mail", "name")
    mails = cut(core_mails.select(F.lower("mail").alias("mail")).filter("mail is not null").distinct(), "mails")
    names = cut(core.filter("name is not null").groupBy("name").agg(F.min("entity_id").alias("known_id")), "names")
    out = None
    while not waiting.isEmpty():
        w = waiting.join(mails.withColumn("_mail", F.lit(True)), "mail", "left").join(names.withColumn("_name", F.lit(True)), "name", "left")
        free_mail, free_name = w.filter("_mail is null"), w.filter("_name is null")
        w = w.join(first_of(free_mail, "mail", "seq").withColumnRenamed("_first", "m1"), "mail", "left").join(first_of(free_name, "name", "seq").withColumnRenamed("_first", "n1"), "name", "left")
        # Decided: a known address; else no earlier undecided row with the address, and the name known or first.
        known_mail = F.coalesce("_mail", F.lit(False))
        own_mail = F.coalesce(F.col("m1") >= F.col("seq"), F.lit(True))
        known_name = F.coalesce("_name", F.lit(False))
        own_name = F.coalesce(F.col("n1") >= F.col("seq"), F.lit(True))
        action = F.when(known_mail, "DUPLICATE_EMAIL").when(own_mail & known_name, "DUPLICATE_NAME").when(own_mail & own_name, "INSERT")
        settled = cut(w.withColumn("verdict", action).filter("verdict is not null").select("seq", "mail", "name", "verdict", "known_id"), "settled")
        out = settled if out is None else out.unionByName(settled)
        mails = cut(mails.unionByName(settled.filter("verdict <> 'DUPLICATE_EMAIL' and mail is not null").select("mail")).distinct(), "mails")
        names = cut(names.unionByName(settled.filter("verdict = 'INSERT' and name is not null").select("name", F.lit(None).cast("long").alias("known_id"))), "names")
        waiting = cut(waiting.join(settled.select("seq"), "seq", "left_anti"), "waiting")
    if out is None:
        out = waiting.select("seq", F.lit("").alias("verdict"), F.lit(0).cast("long").alias("known_id")).limit(0)
    both = routed.join(out.select("seq", "verdict", "known_id"), "seq", "left")
    action = F.coalesce(fixed_actions(both), F.when(F.col("verdict") == "INSERT", "inserted").otherwise("skipped_duplicate"))
    skip = F.when(F.col("verdict") != "INSERT", F.col("verdict"))
    entity = F.when(F.col("route") == "create", F.when(F.col("verdict") == "DUPLICATE_NAME", F.col("known_id"))).otherwise(F.col("entity_id"))
    return both.select(*incoming.columns, action.alias("load_action"), skip.alias("skip_type"), entity.alias("entity_id"))


def contact_values(rows: DataFrame, owner: str, values: dict[str, str], kinds: dict[str, str], preferred: str, clean: Column) -> DataFrame:
    """(owner, value, kind, is_primary) of a payload's addresses or numbers.

    values: column of each kind. Values that `clean` (over x) rejects go, and of equal ones the first kind's stays; the
    preferred kind's value is primary (without a preference, the one of kind primary), else the first.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("key"), F.lit(kinds[k]).alias("kind"), F.col(c).alias("x")) for i, (k, c) in enumerate(values.items())])
    each = rows.select(owner, F.lower(present(preferred)).alias("_preferred"), F.explode(pairs).alias("p")).select(owner, "_preferred", "p.*").withColumn("value", clean).filter("value is not null")
    firsts = each.groupBy(owner, "value").agg(F.min_by(F.struct("place", "key", "kind", "_preferred"), "place").alias("f")).select(owner, "value", "f.*")
    wanted = F.col("key") == F.coalesce("_preferred", F.lit("primary"))
    best = firsts.groupBy(owner).agg(F.min(F.struct((~F.coalesce(wanted, F.lit(False))).alias("other"), "place")).alias("best"))
    return firsts.join(best, owner).select(owner, "value", "kind", (F.col("place") == F.col("best.place")).alias("is_primary"))


def emails(rows: DataFrame, owner: str, values: dict[str, str], preferred: str) -> DataFrame:
    """Addresses of a payload, lower case; those of no valid form go."""
    mail = F.lower(present("x"))
    return contact_values(rows, owner, values, EMAIL_KINDS, preferred, F.when(mail.rlike(EMAIL_PATTERN), mail))


def phones(rows: DataFrame, owner: str, values: dict[str, str], preferred: str) -> DataFrame:
    """Numbers of a payload in E.164."""
    return contact_values(rows, owner, values, PHONE_KINDS, preferred, normalize_phone("x"))


def merge_values(stored: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """stored values of each owner with new ones added; kinds follow the new ones, and a new primary takes the flag from the others."""
    both = stored.select(owner, "value", "kind", "is_primary").alias("s").join(new.alias("n"), [owner, "value"], "full_outer")
    taken = new.filter("is_primary").select(owner, F.lit(True).alias("_taken")).distinct()
    rows = both.select(owner, "value", F.coalesce("n.kind", "s.kind").alias("kind"), F.col("s.is_primary").alias("was"), F.col("n.is_primary").alias("now")).join(taken, owner, "left")
    primary = F.when(F.col("_taken"), F.coalesce("now", F.lit(False))).otherwise(F.coalesce("was", F.lit(False)))
    return rows.select(owner, "value", "kind", primary.alias("is_primary"))


def addresses(rows: DataFrame, owner: str, preferred: str) -> DataFrame:
    """(owner, kind, street, city, state, postal_code, country, is_primary) from struct columns named by kind.

    Street and city are a must; the preferred kind (mailing without a preference) is primary, else the first there.
    """
    kinds = [k for k in ADDRESS_KINDS if k in rows.columns]
    parts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind"), *[F.col(f"{k}.{c}").alias(c) for c in ("street", "city", "state", "postal_code", "country")]) for i, k in enumerate(kinds)])
    each = rows.select(owner, F.coalesce(F.lower(present(preferred)), F.lit("mailing")).alias("_preferred"), F.explode(parts).alias("a")).select(owner, "_preferred", "a.*")
    each = each.filter(present("street").isNotNull() & present("city").isNotNull())
    best = each.groupBy(owner).agg(F.min(F.struct((F.col("kind") != F.col("_preferred")).alias("other"), "place")).alias("best"))
    return each.join(best, owner).select(
        owner, "kind", present("street").alias("street"), present("city").alias("city"), F.coalesce(present("state"), F.lit("")).alias("state"), F.coalesce(present("postal_code"), F.lit("")).alias("postal_code"),
        F.coalesce(present("country"), F.lit("US")).alias("country"), (F.col("place") == F.col("best.place")).alias("is_primary"),
    )


def contact_fields(genders: tuple[str, ...], races: tuple[str, ...], education: tuple[str, ...]) -> dict[str, Column]:
    """What a contact's payload columns are stored as: flags, dates by their ISO head, enums that are known, composed notes."""
    day = lambda c: F.substring(present(c), 1, 10).try_cast("date")
    return {
        "do_not_call": loose_bool("do_not_call"), "do_not_email": loose_bool("do_not_email"), "do_not_contact": loose_bool("do_not_contact"),
        "birthdate": day("birthdate"), "gender": enum_match("gender", genders), "race": enum_match("race", races), "education_level": enum_match("education", education),
        "first_volunteer_date": day("first_volunteer_date"), "last_volunteer_date": day("last_volunteer_date"), "notes": compose_notes("department", "description", "skills_text"),
    }


#: Fields that each record of a contact rewrites, given or not, and those that stay where a record doesn't give them.
REWRITTEN = ("first_name", "last_name", "do_not_call", "do_not_email", "do_not_contact")
KEPT_TEXTS = ("middle_name", "preferred_name", "type", "title", "internal_notes")


def stored_contacts(core: DataFrame, decided: DataFrame, genders: tuple[str, ...], races: tuple[str, ...], education: tuple[str, ...]) -> DataFrame:
    """core (entity_id, source and all contact fields) after the records of a run, with a row for each inserted one.

    decided: seq, load_action, entity_id and the payload's columns. Records without changes rewrite fields as well. Of
    several records of a contact the last by seq that gives a field holds. New contacts get ids after the core's largest,
    by seq; deleted and skipped records change nothing here.
    """
    fields = {**{c: present(c) for c in (*REWRITTEN[:2], *KEPT_TEXTS)}, **contact_fields(genders, races, education)}
    top = core.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("_top"))
    rows = decided.filter(F.col("load_action").isin("inserted", "updated", "no_change")).join(F.broadcast(top))  # one row
    ident = F.when(F.col("load_action") == "inserted", F.col("_top") + F.col("seq")).otherwise(F.col("entity_id"))
    rows = rows.select(ident.alias("entity_id"), "seq", *[v.alias(k) for k, v in fields.items()])
    last = rows.groupBy("entity_id").agg(*[F.max_by(k, "seq" if k in REWRITTEN else F.when(F.col(k).isNotNull(), F.col("seq"))).alias(f"_{k}") for k in fields], F.lit(True).alias("_seen"))
    both = core.join(last, "entity_id", "full_outer")
    now = {k: F.when(F.col("_seen"), F.col(f"_{k}")).otherwise(F.col(k)) if k in REWRITTEN else F.coalesce(f"_{k}", k) for k in fields}
    return both.select("entity_id", F.when(F.col("_seen"), "salesforce").otherwise(F.col("source")).alias("source"), *[v.alias(k) for k, v in now.items()])


def events(incoming: DataFrame, id_map: DataFrame, core: DataFrame) -> DataFrame:
    """incoming (seq, external_id, hash, deleted, title, start_date) with load_action, skip_type and entity_id; title and a start are a must."""
    routed = routes(incoming, id_map, "event", core)
    new = F.col("route") == "create"
    missing = F.when(present("title").isNull(), "title").when(parse_timestamp("start_date").isNull(), "start_date")
    skip = F.when(new & missing.isNotNull(), "MISSING_REQUIRED_FIELD")
    action = F.coalesce(fixed_actions(routed), F.when(missing.isNotNull(), "unchanged").otherwise("inserted"))
    return routed.select(*incoming.columns, action.alias("load_action"), skip.alias("skip_type"), F.when(skip.isNotNull(), missing).alias("missing_field"), F.when(~new, F.col("entity_id")).alias("entity_id"))


def event_rows(decided: DataFrame, taken: DataFrame) -> DataFrame:
    """What inserted events are stored as: picklists, instants, the duration (from the ends, else as given), a slug of their own."""
    start, end = parse_timestamp("start_date"), parse_timestamp("end_date")
    new = decided.filter("load_action = 'inserted'").select(
        "seq", "external_id", "title", picklists.normalize_session_type("event_type").alias("event_type"), picklists.normalize_session_status("event_status").alias("event_status"),
        picklists.normalize_event_format("event_format").alias("event_format"), start.alias("start_date"), end.alias("end_date"),
        F.coalesce(duration_minutes(start, end), present("duration").try_cast("long")).alias("duration"), slugify("title").alias("base"),
    )
    return unique_slugs(new, "base", "seq", taken).drop("base")


def event_organizations(rows: DataFrame, id_map: DataFrame) -> DataFrame:
    """(event_id, organization_id, is_primary) of the district (primary), the school and the parent account, as far as active entries know them.

    The links of an event are replaced as a whole; an organization that comes in by two fields has two links.
    """
    parts = F.array(*[F.struct(F.col(c).cast("string").alias("external_id"), F.lit(p).alias("is_primary")) for c, p in EVENT_LINKS.items()])
    each = rows.select("event_id", F.explode(parts).alias("l")).select("event_id", "l.*").filter(present("external_id").isNotNull())
    known = id_map.filter((F.col("entity_type") == "organization") & F.col("is_active") & F.col("entity_id").isNotNull()).select("external_id", F.col("entity_id").alias("organization_id"))
    return each.join(known, "external_id").select("event_id", "organization_id", "is_primary")


def affiliations(incoming: DataFrame, id_map: DataFrame, core: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(incoming with outcome, skip_type and missing, core after) of affiliation records.

    incoming: seq, external_id, hash, deleted, contact_external_id, organization_external_id, is_primary, start_date,
    end_date, status. core: link_id, contact_id, organization_id, is_primary, start_date, end_date; one link for each pair.
    The contact is looked up first, and a record is skipped for one reason only. A pair that is there is updated, and so
    are later records of a pair. A status other than current ends a link that has no end; a deleted record ends its
    link today. The last record that claims to be primary takes the flag from the contact's other links.
    """
    entry = lambda kind, name: id_map.filter(F.col("entity_type") == kind).select(F.col("external_id").alias(f"{name}_external_id"), F.when(F.col("is_active"), F.col("entity_id")).alias(f"{name}_id"))
    own = id_map.filter("entity_type = 'affiliation'").select("external_id", F.col("entity_id").alias("mapped_link"), F.col("hash").alias("old_hash"))
    rows = incoming.join(entry("contact", "contact"), "contact_external_id", "left").join(entry("organization", "organization"), "organization_external_id", "left").join(own, "external_id", "left")
    gone = F.coalesce("deleted", F.lit(False))
    blank = present("contact_external_id").isNull() | present("organization_external_id").isNull()
    missing = F.when(F.col("contact_id").isNull(), "contact").when(F.col("organization_id").isNull(), "organization")
    fine = present("external_id").isNotNull() & ~gone & ~blank & missing.isNull()
    there = core.select("contact_id", "organization_id", F.lit(True).alias("_there"))
    rows = rows.join(there, ["contact_id", "organization_id"], "left")
    live = rows.filter(fine)
    firsts = live.groupBy("contact_id", "organization_id").agg(F.min("seq").alias("first_seq"))
    rows = rows.join(firsts, ["contact_id", "organization_id"], "left")
    outcome = (
        F.when(present("external_id").isNull(), "skipped").when(gone, F.when(F.col("mapped_link").isNull(), "unchanged").otherwise("deleted")).when(blank | missing.isNotNull(), "skipped")
        .when(F.col("old_hash") == F.col("hash"), "unchanged").when(F.col("_there").isNull() & F.col("mapped_link").isNull() & (F.col("seq") == F.col("first_seq")), "created").otherwise("updated")
    )
    skip = F.when(present("external_id").isNull() | gone, None).when(blank, "MISSING_REQUIRED_FIELD").when(missing.isNotNull(), "MISSING_REFERENCE")
    judged = cut(rows.select(*incoming.columns, "contact_id", "organization_id", "mapped_link", outcome.alias("outcome"), skip.alias("skip_type"), F.when(skip == "MISSING_REFERENCE", missing).alias("missing")), "affiliations")
    applied = judged.filter("outcome in ('created', 'updated')")
    start, end = F.to_date(parse_timestamp("start_date")), F.to_date(parse_timestamp("end_date"))
    ended = F.coalesce(end, F.when(F.coalesce(F.lower(present("status")) != "current", F.lit(False)), today))
    value = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    last = applied.groupBy("contact_id", "organization_id").agg(value(start).alias("s"), value(ended).alias("e"), F.max_by(F.coalesce("is_primary", F.lit(False)), "seq").alias("p"), F.max(F.when(F.col("is_primary"), F.col("seq"))).alias("p_seq"))
    base = core.join(last, ["contact_id", "organization_id"], "full_outer")
    removed = judged.filter("outcome = 'deleted'").select(F.col("mapped_link").alias("link_id"), F.lit(True).alias("_gone")).distinct()
    base = base.join(removed, "link_id", "left").withColumns({"touched": F.col("p").isNotNull(), "primary_seq": F.when(F.col("p"), F.col("p_seq"))})
    winner = base.groupBy("contact_id").agg(F.max("primary_seq").alias("top"))
    base = base.join(winner, "contact_id")
    primary = F.when(F.col("_gone"), False).when(F.col("top").isNotNull(), F.coalesce(F.col("primary_seq") == F.col("top"), F.lit(False))).when(F.col("touched"), False).otherwise(F.col("is_primary"))
    after = base.select("link_id", "contact_id", "organization_id", primary.alias("is_primary"), F.coalesce("s", "start_date", F.when(F.col("link_id").isNull(), today)).alias("start_date"), F.when(F.col("_gone"), today).otherwise(F.coalesce("e", "end_date")).alias("end_date"))
    return judged.drop("mapped_link"), after


def loader_counts(decided: DataFrame, action: str = "load_action") -> DataFrame:
    """One row: created, updated, unchanged, deleted and skipped records."""
    return decided.agg(*[F.count_if(F.col(action).isin(*names, name)).alias(name) for name, names in COUNTERS.items()])


def seen_entries(id_map: DataFrame, decided: DataFrame, entity: str, at: Column, mark: str = "load_action") -> DataFrame:
    """The id map after a load: entries of deleted records become inactive with a reason, those of updated ones active and stamped."""
    last = decided.filter(present("external_id").isNotNull()).groupBy("external_id").agg(F.max_by(F.struct(F.col(mark).alias("a"), "hash"), "seq").alias("l"))
    both = id_map.join(last, "external_id", "left")
    own = (F.col("entity_type") == entity) & F.col("l").isNotNull()
    deleted, seen = own & (F.col("l.a") == "deleted"), own & F.col("l.a").isin("updated", "no_change")
    return both.select(
        "entity_type", "external_id", "entity_id", F.when(deleted, False).when(seen, True).otherwise(F.col("is_active")).alias("is_active"),
        F.when(seen, F.col("l.hash")).otherwise(F.col("hash")).alias("hash"), F.when(deleted | seen, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(deleted, "deleted upstream").when(seen, None).otherwise(F.col("deleted_reason")).alias("deleted_reason"),
    )


def high_water(rows: DataFrame) -> DataFrame:
    """The largest stamp as text, as the loaders compare it."""
    return rows.agg(F.max(present("source_modstamp")).alias("modstamp"), F.max(F.coalesce(present("source_last_modified"), present("source_modstamp"))).alias("updated_at"))


def keyed_upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """stored rows with those of new in their place or added; of several new rows of a key the last by order holds."""
    last = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in stored.columns if c not in key]), order).alias("v")).select(*key, "v.*")
    return stored.join(last.select(*key), key, "left_anti").unionByName(last.select(*stored.columns))


def role_changes(stored: DataFrame, changes: DataFrame, today: Column) -> DataFrame:
    """Roles (person_id, role, start_date, end_date) after adds and ends: an open role isn't added twice, an end closes the open one."""
    open_ = stored.filter("end_date is null")
    ends = changes.filter("op = 'end'").select("person_id", "role", F.lit(True).alias("_end")).distinct()
    closed = stored.join(ends, ["person_id", "role"], "left").select("person_id", "role", "start_date", F.when(F.col("_end") & F.col("end_date").isNull(), today).otherwise(F.col("end_date")).alias("end_date"))
    new = changes.filter("op = 'add'").select("person_id", "role").distinct().join(open_.select("person_id", "role"), ["person_id", "role"], "left_anti")
    return closed.unionByName(new.select("person_id", "role", today.alias("start_date"), F.lit(None).cast("date").alias("end_date")))


def named_items(stored: DataFrame, incoming: DataFrame, owner: str, name: str) -> DataFrame:
    """stored (owner, name) with the trimmed, non-blank names of an array column added once each."""
    each = incoming.select(owner, F.explode(name).alias(name)).select(owner, present(name).alias(name)).filter(F.col(name).isNotNull())
    return stored.unionByName(each.join(stored, [owner, name], "left_anti")).distinct()
