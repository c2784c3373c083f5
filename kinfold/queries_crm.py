"""Queries of the CRM loaders: what each record does, and the tables that follow; with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import crm_load, load
from kinfold.queries_services import sql_view, view
from kinfold.registry import query

# Records come from customers, what is there already from suppliers, and entries of the id map from both.
RECORDS = [
    "c_custkey as seq", "case when c_custkey % 50 = 0 then null else concat('A', c_custkey) end as external_id", "concat('h', c_custkey % 9) as hash", "c_custkey % 17 = 0 as deleted",
    "case when c_custkey % 31 = 0 then ' ' else concat('Org ', c_custkey % 400) end as name", "lower(c_mktsegment) as type",
]
CORE = ["s_suppkey as entity_id", "concat('ORG ', s_suppkey * 3) as name"]
ENTRIES = ["'{0}' as entity_type", "concat('A', c_custkey) as external_id", "c_custkey % 130 as entity_id", "c_custkey % 6 <> 0 as is_active", "concat('h', c_nationkey % 9) as hash"]


def entries(kind: str) -> list[str]:
    return [e.replace("{0}", kind) for e in ENTRIES]


def entry_rows(spark, sf_dir, kind: str):
    return view(spark, sf_dir, "customer", entries(kind)).filter("cast(substr(external_id, 2) as int) % 3 = 0")


def base_sql(kind: str, records: list[str], core: list[str]) -> str:
    """records i, core c, entries m of the id map, and the route of each record."""
    return f"""{sql_view('i', 'customer', records)}, {sql_view('c', 'supplier', core)}, m as (select * from (select {', '.join(entries(kind))} from customer) where cast(substr(external_id, 2) as int) % 3 = 0),
routed as (select i.*, m.entity_id, m.is_active, m.hash as old_hash, case when trim(coalesce(i.external_id, '')) = '' then 'none' when deleted then 'delete' when c.entity_id is not null then 'update' else 'create' end as route
  from i left join m on m.external_id = i.external_id left join c on c.entity_id = m.entity_id)"""


FIXED_SQL = "case route when 'none' then 'unchanged' when 'delete' then case when entity_id is not null and not is_active then 'unchanged' else 'deleted' end when 'update' then case when old_hash = hash then 'no_change' else 'updated' end end"
ORGANIZATIONS_SQL = f"""with {base_sql('organization', RECORDS, CORE)}, k as (select *, lower(nullif(trim(name), '')) as key from routed),
d as (select k.*, (select min(c.entity_id) from c where lower(c.name) = key) as known_id, (select min(o.seq) from k o where o.key = k.key and o.route = 'create') as first_seq from k),
decided as (select seq, external_id, name, type, hash, coalesce({FIXED_SQL}, case when key is null then 'unchanged' when known_id is not null or seq > first_seq then 'skipped_duplicate' else 'inserted' end) as load_action,
  case when route = 'create' and key is null then 'MISSING_REQUIRED_FIELD' when route = 'create' and (known_id is not null or seq > first_seq) then 'DUPLICATE_NAME' end as skip_type,
  case when route = 'create' then known_id else entity_id end as entity_id from d)"""


def decided_organizations(spark, sf_dir):
    return crm_load.organizations(view(spark, sf_dir, "customer", RECORDS), entry_rows(spark, sf_dir, "organization"), view(spark, sf_dir, "supplier", CORE))


@query(ORGANIZATIONS_SQL + " select seq, load_action, skip_type, entity_id from decided")
def crm_organization_actions(spark, sf_dir):
    return decided_organizations(spark, sf_dir).select("seq", "load_action", "skip_type", "entity_id")


@query(ORGANIZATIONS_SQL + """ select count(*) filter (load_action = 'inserted') as created, count(*) filter (load_action = 'updated') as updated, count(*) filter (load_action in ('no_change', 'unchanged', 'skipped_duplicate')) as unchanged,
  count(*) filter (load_action = 'deleted') as deleted, cast(0 as bigint) as skipped from decided""")
def crm_loader_counts(spark, sf_dir):
    return crm_load.loader_counts(decided_organizations(spark, sf_dir))


@query(ORGANIZATIONS_SQL + """ select seq, 'org-' || (seq % 400) || case when seq % 400 in (select s_suppkey from supplier where s_suppkey % 7 = 0) then '-1' else '' end as slug,
  case when contains('building automobile machinery household furniture', type) then 'other' else 'other' end as organization_type from decided where load_action = 'inserted'""")
def crm_organization_rows(spark, sf_dir):
    """New organizations with slugs of their own; some are taken already."""
    taken = view(spark, sf_dir, "supplier", ["concat('org-', s_suppkey) as slug", "s_suppkey"]).filter("s_suppkey % 7 = 0")
    return crm_load.organization_rows(decided_organizations(spark, sf_dir), taken).select("seq", "slug", "organization_type")


@query(ORGANIZATIONS_SQL + """, n as (select entity_id, string_agg('Linked from CRM import (run 5, external_id: ' || external_id || ')', chr(10) || chr(10) order by 'Linked from CRM import (run 5, external_id: ' || external_id || ')') as note from decided where skip_type = 'DUPLICATE_NAME' and entity_id is not null group by 1)
select s_suppkey as entity_id, nullif(concat_ws(chr(10) || chr(10), case when s_suppkey % 2 = 0 then s_name end, note), '') as description from supplier left join n on n.entity_id = s_suppkey""")
def crm_linked_notes(spark, sf_dir):
    core = view(spark, sf_dir, "supplier", ["s_suppkey as entity_id", "case when s_suppkey % 2 = 0 then s_name end as description"])
    return crm_load.linked_notes(core, decided_organizations(spark, sf_dir), 5)


CONTACTS = [*RECORDS[:4], "case when c_custkey % 6 = 0 then null else concat('mail', c_custkey % 300, '@x.org') end as mail", "case when c_custkey % 8 = 0 then null else concat('anna no', c_custkey % 210) end as name"]
PEOPLE = ["s_suppkey as entity_id", "concat('anna no', s_suppkey * 5) as name", "concat('mail', s_suppkey * 4, '@x.org') as mail"]
CONTACTS_SQL = f"""with recursive {base_sql('contact', CONTACTS, PEOPLE)}, w as (select row_number() over (order by seq) as i, seq, mail, name from routed where route = 'create'),
st(i, seq, verdict, known, mails, names) as (select cast(0 as bigint), cast(null as bigint), '', cast(null as bigint), (select list(mail) from c), (select list(name) from c) union all
  select i, seq, v, case when v = 'DUPLICATE_NAME' then (select min(entity_id) from c where c.name = x.name) end, case when v <> 'DUPLICATE_EMAIL' and mail is not null then list_append(mails, mail) else mails end,
    case when v = 'INSERT' and name is not null then list_append(names, name) else names end
  from (select w.i, w.seq, w.mail, w.name, mails, names, case when w.mail is not null and list_contains(mails, w.mail) then 'DUPLICATE_EMAIL' when w.name is not null and list_contains(names, w.name) then 'DUPLICATE_NAME' else 'INSERT' end as v
    from st join w on w.i = st.i + 1) x)
select r.seq, coalesce({FIXED_SQL}, case when verdict = 'INSERT' then 'inserted' else 'skipped_duplicate' end) as load_action, nullif(verdict, 'INSERT') as skip_type, case when route = 'create' then known else entity_id end as entity_id
from routed r left join st on st.seq = r.seq"""


@query(CONTACTS_SQL)
def crm_contact_actions(spark, sf_dir):
    core = view(spark, sf_dir, "supplier", PEOPLE)
    done = crm_load.contacts(view(spark, sf_dir, "customer", CONTACTS), entry_rows(spark, sf_dir, "contact"), core.select("entity_id", "name"), core.select("mail"))
    return done.select("seq", "load_action", "skip_type", "entity_id")


MAILS = ["c_custkey as person_id", "case when c_custkey % 3 = 0 then null else concat(' Ann', c_custkey % 5, '@X.org') end as m_primary", "concat('ann', c_nationkey % 5, '@x.org') as m_home", "case when c_custkey % 4 = 0 then 'broken' else concat('work', c_custkey, '@x.org') end as m_work", "'other@x.org' as m_alternate", "case c_custkey % 5 when 0 then 'Work' when 1 then 'alternate' when 2 then null when 3 then 'fax' else ' ' end as preferred"]
MAILS_SQL = f"""{sql_view('p', 'customer', MAILS)}, e as (select person_id, lower(nullif(trim(preferred), '')) as preferred, unnest([0, 1, 2, 3]) as place, unnest(['primary', 'home', 'work', 'alternate']) as key, unnest(['personal', 'personal', 'work', 'other']) as kind, unnest([m_primary, m_home, m_work, m_alternate]) as raw from p),
v as (select person_id, preferred, place, key, kind, lower(trim(raw)) as value from e where contains(raw, '@')), u as (select * from v qualify row_number() over (partition by person_id, value order by place) = 1),
applied as (select person_id, value, kind, row_number() over (partition by person_id order by case when key = coalesce(preferred, 'primary') then 0 else 1 end, place) = 1 as is_primary from u)"""


@query(f"with {MAILS_SQL} select * from applied")
def crm_contact_emails(spark, sf_dir):
    columns = {"primary": "m_primary", "home": "m_home", "work": "m_work", "alternate": "m_alternate"}
    return crm_load.emails(view(spark, sf_dir, "customer", MAILS), "person_id", columns, "preferred")


@query(f"""with {MAILS_SQL}, s as (select c_custkey as person_id, 'other@x.org' as value, 'personal' as kind, true as is_primary from customer where c_custkey % 2 = 0)
select coalesce(s.person_id, a.person_id) as person_id, coalesce(s.value, a.value) as value, coalesce(a.kind, s.kind) as kind,
  case when exists (select 1 from applied b where b.person_id = coalesce(s.person_id, a.person_id) and b.is_primary) then coalesce(a.is_primary, false) else coalesce(s.is_primary, false) end as is_primary
from s full join applied a on a.person_id = s.person_id and a.value = s.value""")
def crm_merged_emails(spark, sf_dir):
    stored = view(spark, sf_dir, "customer", ["c_custkey as person_id", "'other@x.org' as value", "'personal' as kind", "true as is_primary"]).filter("person_id % 2 = 0")
    return crm_load.merge_values(stored, crm_contact_emails(spark, sf_dir), "person_id")


NUMBERS = ["c_custkey as person_id", "case when c_custkey % 3 = 0 then null else '(816) 555-0100' end as n_primary", "concat('816555', 1000 + c_custkey % 9000) as n_mobile", "'12' as n_home", "case when c_custkey % 2 = 0 then 'mobile' end as preferred"]


@query("""select c_custkey as person_id, '+1816555' || (1000 + c_custkey % 9000) as value, 'mobile' as kind, c_custkey % 2 = 0 or c_custkey % 3 = 0 as is_primary from customer
union all select c_custkey, '+18165550100', 'mobile', c_custkey % 2 <> 0 from customer where c_custkey % 3 <> 0""")
def crm_contact_phones(spark, sf_dir):
    return crm_load.phones(view(spark, sf_dir, "customer", NUMBERS), "person_id", {"primary": "n_primary", "mobile": "n_mobile", "home": "n_home"}, "preferred")


@query("""with e as (select c_custkey as person_id, 0 as place, 'mailing' as kind, 'Main ' || c_custkey as street, case when c_custkey % 3 <> 0 then 'KC' end as city, 'MO' as state from customer
union all select c_custkey, 1, 'home', case when c_custkey % 4 <> 0 then 'Home' else ' ' end, 'Lee', null from customer), f as (select * from e where trim(street) <> '' and city is not null)
select person_id, kind, street, city, coalesce(state, '') as state, '' as postal_code, 'US' as country, row_number() over (partition by person_id order by case when kind = case when person_id % 5 = 0 then 'home' else 'mailing' end then 0 else 1 end, place) = 1 as is_primary from f""")
def crm_contact_addresses(spark, sf_dir):
    none = F.lit(None).cast("string")
    part = lambda street, city, state: F.struct(street.alias("street"), city.alias("city"), state.alias("state"), none.alias("postal_code"), none.alias("country"))
    k = F.col("person_id")
    rows = view(spark, sf_dir, "customer", ["c_custkey as person_id"]).withColumns({
        "mailing": part(F.concat(F.lit("Main "), k.cast("string")), F.when(k % 3 != 0, "KC"), F.lit("MO")),
        "home": part(F.when(k % 4 != 0, "Home").otherwise(" "), F.lit("Lee"), none),
        "preferred": F.when(k % 5 == 0, "Home"),
    })
    return crm_load.addresses(rows, "person_id", "preferred")


EVENTS = [*RECORDS[:4], "case when c_custkey % 11 = 0 then '' else concat('Fair ', c_custkey % 40) end as title", "case when c_custkey % 13 = 0 then 'soon' else '2024-03-01T09:00:00Z' end as start_date", "case when c_custkey % 2 = 0 then '2024-03-01T10:30:00Z' end as end_date", "'45' as duration", "case when c_custkey % 3 = 0 then 'Workshop' else 'campus visit' end as event_type", "'Completed' as event_status", "'Online' as event_format"]
HAPPENED = ["s_suppkey as entity_id"]
EVENTS_SQL = f"""with {base_sql('event', EVENTS, HAPPENED)}, d as (select *, case when trim(title) = '' then 'title' when start_date = 'soon' then 'start_date' end as lacks from routed),
decided as (select *, coalesce({FIXED_SQL}, case when lacks is not null then 'unchanged' else 'inserted' end) as load_action from d)"""


def decided_events(spark, sf_dir):
    return crm_load.events(view(spark, sf_dir, "customer", EVENTS), entry_rows(spark, sf_dir, "event"), view(spark, sf_dir, "supplier", HAPPENED))


@query(EVENTS_SQL + " select seq, load_action, case when route = 'create' and lacks is not null then 'MISSING_REQUIRED_FIELD' end as skip_type, case when route = 'create' then lacks end as missing_field, case when route <> 'create' then entity_id end as entity_id from decided")
def crm_event_actions(spark, sf_dir):
    return decided_events(spark, sf_dir).select("seq", "load_action", "skip_type", "missing_field", "entity_id")


@query(EVENTS_SQL + """, n as (select *, row_number() over (partition by title order by seq) - 1 as k from decided where load_action = 'inserted')
select seq, case when event_type = 'Workshop' then 'workshop' else 'community_event' end as event_type, 'completed' as event_status, 'virtual' as event_format, case when end_date is not null then 90 else 45 end as duration,
  'fair-' || (seq % 40) || case when seq % 40 = 7 then '-' || (k + 3) when k = 0 then '' else '-' || k end as slug from n""")
def crm_event_rows(spark, sf_dir):
    """New events; of the seventh fair some slugs are taken."""
    taken = spark.createDataFrame([("fair-7",), ("fair-7-1",), ("fair-7-2",)], "slug string")
    return crm_load.event_rows(decided_events(spark, sf_dir), taken).select("seq", "event_type", "event_status", "event_format", "duration", "slug")


@query("""with m as (select 'A' || c_custkey as external_id, c_custkey % 130 as organization_id from customer where c_custkey % 3 = 0 and c_custkey % 6 <> 0), e as (select o_orderkey as event_id, unnest(['A' || (o_custkey % 90), case when o_orderkey % 2 = 0 then 'A' || (o_custkey % 70) end, 'A9']) as external_id, unnest([true, false, false]) as is_primary from orders)
select event_id, organization_id, is_primary from e join m using (external_id)""")
def crm_event_organizations(spark, sf_dir):
    rows = view(spark, sf_dir, "orders", ["o_orderkey as event_id", "concat('A', o_custkey % 90) as district_id", "case when o_orderkey % 2 = 0 then concat('A', o_custkey % 70) end as school_id", "'A9' as parent_account_id"])
    return crm_load.event_organizations(rows, entry_rows(spark, sf_dir, "organization"))


AFFILIATIONS = [
    "o_orderkey as seq", "case when o_orderkey % 40 = 0 then null else concat('F', o_orderkey) end as external_id", "concat('h', o_orderkey % 4) as hash", "o_orderkey % 23 = 0 as deleted", "case when o_orderkey % 19 = 0 then '' else concat('A', o_custkey) end as contact_external_id",
    "concat('A', o_orderkey % 60) as organization_external_id", "o_orderkey % 5 = 0 as is_primary", "case when o_orderkey % 3 = 0 then '2020-02-03' end as start_date", "cast(null as string) as end_date", "case when o_orderkey % 7 = 0 then 'Former' else 'Current' end as status",
]
LINKED = ["s_suppkey as link_id", "s_suppkey as contact_id", "3 as organization_id", "s_suppkey % 2 = 0 as is_primary", "date'2019-01-01' as start_date", "cast(null as date) as end_date"]
AFFILIATIONS_SQL = f"""with {sql_view('i', 'orders', AFFILIATIONS)}, {sql_view('c', 'supplier', LINKED)}, m as (select 'A' || c_custkey as external_id, c_custkey % 130 as entity_id from customer where c_custkey % 3 = 0 and c_custkey % 6 <> 0),
f as (select 'F' || s_suppkey as external_id, s_suppkey as link, 'h1' as old_hash from supplier),
j as (select i.*, a.entity_id as contact_id, b.entity_id as organization_id, f.link, f.old_hash, exists (select 1 from c where c.contact_id = a.entity_id and c.organization_id = b.entity_id) as there
  from i left join m a on a.external_id = contact_external_id left join m b on b.external_id = organization_external_id left join f on f.external_id = i.external_id),
k as (select *, external_id is not null and not deleted and contact_external_id <> '' and contact_id is not null and organization_id is not null as fine from j),
d as (select *, min(case when fine then seq end) over (partition by contact_id, organization_id) as first_seq from k),
judged as (select *, case when external_id is null then 'skipped' when deleted then case when link is null then 'unchanged' else 'deleted' end when not fine then 'skipped' when old_hash = hash then 'unchanged' when not there and link is null and seq = first_seq then 'created' else 'updated' end as outcome,
  case when external_id is null or deleted then null when contact_external_id = '' then 'MISSING_REQUIRED_FIELD' when contact_id is null or organization_id is null then 'MISSING_REFERENCE' end as skip_type from d)"""


def loaded_affiliations(spark, sf_dir):
    maps = entry_rows(spark, sf_dir, "contact").unionByName(entry_rows(spark, sf_dir, "organization"))
    maps = maps.unionByName(view(spark, sf_dir, "supplier", ["'affiliation' as entity_type", "concat('F', s_suppkey) as external_id", "s_suppkey as entity_id", "true as is_active", "'h1' as hash"]))
    return crm_load.affiliations(view(spark, sf_dir, "orders", AFFILIATIONS), maps, view(spark, sf_dir, "supplier", LINKED), F.to_date(F.lit("2024-05-06")))


@query(AFFILIATIONS_SQL + " select seq, outcome, skip_type, case when skip_type = 'MISSING_REFERENCE' then case when contact_id is null then 'contact' else 'organization' end end as missing from judged")
def crm_affiliation_outcomes(spark, sf_dir):
    return loaded_affiliations(spark, sf_dir)[0].select("seq", "outcome", "skip_type", "missing")


@query(AFFILIATIONS_SQL + """, u as (select contact_id, organization_id, max(case when start_date is not null then date '2020-02-03' end) as s, max(case when status = 'Former' then date '2024-05-06' end) as e, arg_max(is_primary, seq) as p, max(case when is_primary then seq end) as ps
  from judged where outcome in ('created', 'updated') group by 1, 2),
b as (select coalesce(c.contact_id, u.contact_id) as contact_id, coalesce(c.organization_id, u.organization_id) as organization_id, link_id, c.is_primary, c.start_date, u.s, u.e, u.p, case when u.p then ps end as ps, exists (select 1 from judged g where g.outcome = 'deleted' and g.link = link_id) as gone from c full join u on u.contact_id = c.contact_id and u.organization_id = c.organization_id),
t as (select *, max(ps) over (partition by contact_id) as top from b)
select contact_id, organization_id, case when gone then false when top is not null then coalesce(ps = top, false) when p is not null then false else is_primary end as is_primary, coalesce(s, start_date, date '2024-05-06') as start_date, case when gone then date '2024-05-06' else e end as end_date from t""")
def crm_affiliation_links(spark, sf_dir):
    return loaded_affiliations(spark, sf_dir)[1].select("contact_id", "organization_id", "is_primary", "start_date", "end_date")


@query(ORGANIZATIONS_SQL + """ select external_id, entity_id, case when a = 'deleted' then false when a in ('updated', 'no_change') then true else is_active end as is_active, case when a in ('updated', 'no_change') then h else hash end as hash,
  case when a = 'deleted' then 'deleted upstream' when a in ('updated', 'no_change') then null else 'old' end as deleted_reason from m left join (select external_id as x, load_action as a, hash as h from decided) on x = external_id""")
def crm_seen_entries(spark, sf_dir):
    maps = entry_rows(spark, sf_dir, "organization").withColumns({"last_seen_at": F.to_timestamp(F.lit("2020-01-01")), "deleted_reason": F.lit("old")})
    return crm_load.seen_entries(maps, decided_organizations(spark, sf_dir), "organization", F.to_timestamp(F.lit("2024-01-01"))).select("external_id", "entity_id", "is_active", "hash", "deleted_reason")


@query("""with c as (select c_custkey as person_id, 'volunteer' as role, date '2020-01-01' as start_date, case when c_custkey % 3 = 0 then date '2021-01-01' end as end_date from customer)
select person_id, role, start_date, case when person_id % 4 = 1 and end_date is null then date '2024-05-06' else end_date end as end_date from c
union all select c_custkey, 'volunteer', date '2024-05-06', null from customer where c_custkey % 6 = 0 union all select c_custkey, 'mentor', date '2024-05-06', null from customer where c_custkey % 5 = 0""")
def crm_role_changes(spark, sf_dir):
    stored = view(spark, sf_dir, "customer", ["c_custkey as person_id", "'volunteer' as role", "date'2020-01-01' as start_date", "case when c_custkey % 3 = 0 then date'2021-01-01' end as end_date"])
    change = lambda op, role, where: view(spark, sf_dir, "customer", ["c_custkey as person_id", f"'{role}' as role", f"'{op}' as op"]).filter(where)
    changes = change("end", "volunteer", "person_id % 4 = 1").unionByName(change("add", "volunteer", "person_id % 2 = 0")).unionByName(change("add", "mentor", "person_id % 5 = 0"))
    return crm_load.role_changes(stored, changes, F.to_date(F.lit("2024-05-06")))


@query("select distinct l_suppkey as person_id, case when l_linenumber % 2 = 0 then 'even' else 'line ' || l_linenumber end as skill from lineitem union select s_suppkey, 'even' from supplier")
def crm_named_skills(spark, sf_dir):
    stored = view(spark, sf_dir, "supplier", ["s_suppkey as person_id", "'even' as skill"])
    incoming = view(spark, sf_dir, "lineitem", ["l_suppkey as person_id", "array(case when l_linenumber % 2 = 0 then ' even ' else concat('line ', l_linenumber) end, ' ', null) as skill"])
    return crm_load.named_items(stored, incoming, "person_id", "skill")


@query("select s_suppkey as name, coalesce((select arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_partkey, l_extendedprice)) from lineitem where l_suppkey = s_suppkey and l_linenumber = 3), s_acctbal) as value from supplier")
def keyed_metric_upsert(spark, sf_dir):
    stored = view(spark, sf_dir, "supplier", ["s_suppkey as name", "s_acctbal as value"])
    new = view(spark, sf_dir, "lineitem", ["l_suppkey as name", "l_extendedprice as value", "struct(l_shipdate, l_orderkey, l_partkey, l_extendedprice) as stamp", "l_linenumber"]).filter("l_linenumber = 3")
    return crm_load.keyed_upsert(stored, new, ["name"], "stamp")


@query("select row_number() over (order by o_orderkey) as sequence_number, 'landed' as status, o_orderkey % 3 = 0 and o_custkey % 2 = 0 as missing_contact_info from orders")
def crm_staged_contacts(spark, sf_dir):
    rows = view(spark, sf_dir, "orders", ["o_orderkey as id", "case when o_orderkey % 3 = 0 then ' ' else 'a@b.org' end as email", "case when o_custkey % 2 = 0 then null else '555' end as phone"])
    return crm_load.staged(rows, 4, "contact", "id").select("sequence_number", "status", "missing_contact_info")


PREFER = ["l_suppkey as owner", "l_partkey % 9 as value", "case when l_linenumber = 4 then 'Work' else 'home' end as kind", "l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 10 * 10 + l_linenumber as place"]


@query(f"with {sql_view('p', 'lineitem', PREFER)}, u as (select owner, value, min_by(kind, place) as kind, min(place) as place from p group by 1, 2) select owner, value, kind, row_number() over (partition by owner order by case when lower(kind) = 'work' then 0 else 1 end, place) = 1 as is_primary from u")
def preferred_values(spark, sf_dir):
    return load.pick_by_preference(view(spark, sf_dir, "lineitem", PREFER), "owner", "kind", F.lit("work"), "place", "value").select("owner", "value", "kind", "is_primary")
