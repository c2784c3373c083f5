"""Search, scope and point-lookup predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import present

AUTOCOMPLETE_ROWS = 20


def contains_any(term: str, *columns: str) -> Column:
    """Case-insensitive match of the term anywhere in any column; % and _ of the term stay wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return hit


def multi_search(frame: DataFrame, key: str, term: str, columns: list[str], children: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows that match in a column or have a matching child row: (child, foreign key, column); one distinct key set is joined."""
    own = frame.filter(contains_any(term, *columns)).select(key)
    for child, fk, column in children:
        own = own.unionByName(child.filter(contains_any(term, column)).select(F.col(fk).alias(key)))
    return frame.join(own.distinct(), key, "left_semi")


def preference(column: str, wanted: bool | None) -> Column:
    """A tri-state filter: null takes all."""
    return F.lit(True) if wanted is None else F.coalesce(F.col(column), F.lit(False)) == wanted


def in_scope(frame: DataFrame, key: str, *links: tuple[DataFrame, str]) -> DataFrame:
    """Rows that any of the links holds."""
    ids = None
    for link, fk in links:
        part = link.select(F.col(fk).alias(key))
        ids = part if ids is None else ids.unionByName(part)
    return frame.join(ids.distinct(), key, "left_semi")


def current(end: str, flag: str | None = None) -> Column:
    """Links without an end, or with an active flag."""
    now = F.col(end).isNull()
    return now if flag is None else now & F.col(flag)


def without_child(frame: DataFrame, key: str, child: DataFrame, fk: str) -> DataFrame:
    return frame.join(child.select(F.col(fk).alias(key)).distinct(), key, "left_anti")


def with_primary(frame: DataFrame, key: str, child: DataFrame, fk: str, value: str, primary: str, ident: str) -> DataFrame:
    """frame with the value of the primary child, null if there is none; the flag belongs to the join, not to a filter after it."""
    best = child.filter(primary).groupBy(F.col(fk).alias(key)).agg(F.min_by(value, ident).alias(value))
    return frame.join(best, key, "left")


def first_child(child: DataFrame, fk: str, value: str, primary: Column, ident: str) -> DataFrame:
    """The primary child's value, else the first one's."""
    return child.groupBy(fk).agg(F.min_by(value, F.struct((~primary).cast("int"), F.col(ident))).alias(value))


def nested_children(frame: DataFrame, key: str, child: DataFrame, fk: str, name: str, fields: list[str]) -> DataFrame:
    """frame with an array of its children, so no row fans out."""
    grouped = child.groupBy(F.col(fk).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return frame.join(grouped, key, "left")


def autocomplete(organizations: DataFrame, term: str, limit: int = AUTOCOMPLETE_ROWS) -> DataFrame:
    return organizations.filter(F.col("is_active") & contains_any(term, "name", "slug")).orderBy("name", "id").limit(limit)


def permissions_of(users: DataFrame, memberships: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, organization_id, permission) by active membership and role; super admins have all in all."""
    by_role = memberships.filter("is_active").join(grants, "role_id").select("user_id", "organization_id", "permission")
    every = users.filter("is_super_admin").select("user_id").join(F.broadcast(grants.select("permission").distinct()))  # a fixed, small list
    return by_role.unionByName(every.select("user_id", F.lit(None).cast("long").alias("organization_id"), "permission")).distinct()


def roles_up_to(roles: DataFrame, level: int) -> DataFrame:
    return roles.filter(F.col("level") <= level)


def autocomplete_for(organizations: DataFrame, term: str, memberships: DataFrame, user_id: int, super_admin: bool, limit: int = AUTOCOMPLETE_ROWS) -> DataFrame:
    """autocomplete among the organizations that a user can see."""
    return autocomplete(organizations if super_admin else visible_organizations(organizations, memberships, user_id), term, limit)


def visible_organizations(organizations: DataFrame, memberships: DataFrame, user_id: int, super_admin: bool = False) -> DataFrame:
    """Active organizations of a user's active memberships, or all active ones."""
    active = organizations.filter("is_active")
    if super_admin:
        return active
    own = memberships.filter(F.col("is_active") & (F.col("user_id") == user_id)).select(F.col("organization_id").alias("id")).distinct()
    return active.join(own, "id", "left_semi")


def event_search(events: DataFrame, term: str) -> DataFrame:
    return events.filter(contains_any(term, "title", "description", "location"))


def active_volunteers(people: DataFrame, links: DataFrame, organization_id: int) -> DataFrame:
    """Active people with a current link to an organization, each once."""
    own = links.filter((F.col("organization_id") == organization_id) & current("end_date")).select("person_id").distinct()
    return people.filter("status = 'active'").join(own, "person_id", "left_semi")


def event_people(people: DataFrame, links: DataFrame, event_id: int, role: str | None = None) -> DataFrame:
    """People of an event with their role; those who cancelled are left out."""
    own = links.filter((F.col("event_id") == event_id) & (F.col("status") != "cancelled"))
    own = own if role is None else own.filter(F.col("role") == role)
    return people.join(own.select("person_id", "role").distinct(), "person_id")


def attendance(links: DataFrame) -> DataFrame:
    """Confirmed people of each event."""
    return links.groupBy("event_id").agg(F.count_distinct(F.when(F.col("status") == "confirmed", F.col("person_id"))).alias("confirmed"))


def by_primary_value(people: DataFrame, values: DataFrame, value: str, wanted: str) -> DataFrame:
    """The people whose primary address or number is exactly that one."""
    return people.join(values.filter(F.col("is_primary") & (F.col(value) == wanted)).select("person_id").distinct(), "person_id", "left_semi")


def by_slug(rows: DataFrame, slug: str) -> DataFrame:
    return rows.filter(F.col("slug") == slug)


def map_metadata(contacts: DataFrame, id_map: DataFrame, system: str = "crm") -> DataFrame:
    """contacts with the metadata of their last seen entry of a system."""
    own = id_map.filter((F.col("entity_type") == "contact") & (F.col("external_system") == system))
    last = own.groupBy("entity_id").agg(F.max_by("metadata", F.struct("last_seen_at", "external_id")).alias("metadata"))
    return contacts.join(last.withColumnRenamed("entity_id", "person_id"), "person_id", "left")


# What a stored row must satisfy, by rule.
def integrity_rules(today: Column) -> dict[str, tuple[str, Column]]:
    """(table, broken) of each rule: positive hours, ends after starts, named fields, births in the past."""
    return {
        "HOURS_POSITIVE": ("hours", F.coalesce(F.col("hours") <= 0, F.lit(True))),
        "END_AFTER_START": ("slots", F.coalesce(F.col("end_time") <= F.col("start_time"), F.lit(False))),
        "FIELD_NAMED": ("changes", present("field_name").isNull()),
        "BIRTH_PAST": ("people", F.coalesce(F.col("birthdate") > today, F.lit(False))),
    }


def integrity_violations(tables: dict[str, DataFrame], idents: dict[str, str], today: Column) -> DataFrame:
    """(rule, table, row_id) of every stored row that breaks a rule."""
    out = None
    for rule, (name, broken) in integrity_rules(today).items():
        if name in tables:
            part = tables[name].filter(broken).select(F.lit(rule).alias("rule"), F.lit(name).alias("table"), F.col(idents[name]).cast("string").alias("row_id"))
            out = part if out is None else out.unionByName(part)
    return out


# Limits of what a form takes.
SLUG_PATTERN, USERNAME_PATTERN = "^[a-z0-9]+(?:-[a-z0-9]+)*$", "^[A-Za-z0-9_.-]{3,64}$"
MOST_COST = 1_000_000


def event_form_errors(today: Column) -> Column:
    """What is wrong with a new event: slug, cost, a start in the past, a deadline after the start."""
    cost = F.col("cost")
    checks = {
        "slug": ~F.coalesce(F.col("slug").rlike(SLUG_PATTERN), F.lit(True)), "cost": F.coalesce((cost < 0) | (cost > MOST_COST), F.lit(False)),
        "start_date": F.coalesce(F.col("start_date") < today, F.lit(False)), "registration_deadline": F.coalesce(F.col("registration_deadline") >= F.col("start_date"), F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))


def username_ok(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(USERNAME_PATTERN), F.lit(False))
