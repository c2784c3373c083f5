"""Queries of composed payloads, the clean layer, stored CRM contacts, sample reports and values written back; with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import clean, crm_load, merge, reports, sampling
from kinfold.queries_crm import CONTACTS, CONTACTS_SQL, PEOPLE, entry_rows
from kinfold.queries_services import sql_view, view
from kinfold.registry import query

AS_OF = "2024-01-30"
BIRTH = "date'1895-01-01' + cast(c_custkey * 37 % 50000 as int)"


def maps(spark, sf_dir, name: str, key: str, raw: dict[str, str], normalized: dict[str, str]):
    """Staged rows with payloads from expressions; null values are in the maps, 'absent' ones aren't."""
    made = lambda parts: "map_filter(map(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + "), (k, v) -> v is null or v <> 'absent')"
    return view(spark, sf_dir, name, [f"{key} as row_id", f"{made(raw)} as raw", f"{made(normalized)} as normalized", f"case when {key} % 7 = 0 then 'quarantined' else 'validated' end as status", "'crm' as external_system", f"concat('X', {key}) as external_id"])


VOLUNTEER_RAW = {
    "Email": "case when c_custkey % 3 = 0 then concat(' m', c_custkey, '@x.org ') when c_custkey % 3 = 1 then ' ' end", "Phone": "case when c_custkey % 4 = 0 then ' 1 ' when c_custkey % 4 = 1 then ' ' else '' end",
    "MobilePhone": "case when c_custkey % 2 = 0 then '22' end", "Other": "'raw'",
}
VOLUNTEER_NORMALIZED = {
    "email": "case c_custkey % 5 when 0 then '' when 1 then '{\"home\": 1}' else 'absent' end", "email_normalized": "case when c_custkey % 11 = 0 then ' n ' when c_custkey % 11 = 1 then '' else 'absent' end",
    "VOL_EMAIL": "case when c_custkey % 2 = 0 then 'v@x.org' else 'absent' end", "phone": "case when c_custkey % 6 = 0 then null else 'absent' end", "VOL_PHONE": "case when c_custkey % 9 = 0 then '99' else 'absent' end", "Other": "case when c_custkey % 8 = 0 then 'own' else 'absent' end",
}


@query("""with c as (select c_custkey as k, case when k % 3 = 0 then 'm' || k || '@x.org' end as e, case when k % 4 = 0 then '1' when k % 4 = 2 then '22' end as p,
  case k % 5 when 0 then '' when 1 then '{"home": 1}' end as ne, k % 11 = 0 as has_n, k % 11 <= 1 as has_key from customer)
select k as row_id,
  case when e is not null then case when ne = '{"home": 1}' then ne else e end when ne = '{"home": 1}' then ne when has_n then 'n' when has_key then ne when k % 2 = 0 then 'v@x.org' else ne end as email,
  case when e is not null and (ne = '') then e when has_n and e is null and ne = '{"home": 1}' then ' n ' when has_n and e is null then 'n' when has_n then ' n ' when has_key then '' when e is not null then e end as email_normalized,
  case when p is not null then p when k % 9 = 0 then '99' end as phone, case when p is not null and k % 6 = 0 then p end as phone_e164, case when k % 8 = 0 then 'own' else 'raw' end as other from c""")
def composed_volunteers(spark, sf_dir):
    out = clean.composed(maps(spark, sf_dir, "customer", "c_custkey", VOLUNTEER_RAW, VOLUNTEER_NORMALIZED), "volunteer", payload="p")
    return out.select("row_id", *[F.col("p")[k].alias(k) for k in ("email", "email_normalized", "phone", "phone_e164")], F.col("p")["Other"].alias("other"))


ENTITIES = {
    "organization": ("supplier", "s_suppkey", {"Name": "case when s_suppkey % 3 = 0 then '' else concat(' Raw ', s_suppkey) end"}, {"name": "case s_suppkey % 4 when 0 then concat('Own ', s_suppkey) when 1 then ' ' when 2 then 'absent' end", "external_id": "case when s_suppkey % 5 = 0 then concat('N', s_suppkey) else 'absent' end"}),
    "affiliation": ("orders", "o_orderkey", {"npe5__Contact__c": "case when o_orderkey % 3 <> 0 then concat('C', o_custkey) end", "npe5__Organization__c": "concat('O', o_orderkey % 9)", "external_system": "case when o_orderkey % 2 = 0 then 'other' end"}, {"contact_external_id": "case when o_orderkey % 6 = 0 then 'C0' else 'absent' end"}),
    "event": ("part", "p_partkey", {"Name": "p_name"}, {"title": "case when p_partkey % 2 = 0 then concat(p_name, ' day') else 'absent' end"}),
}


def promoted(spark, sf_dir, entity: str):
    name, key, raw, normalized = ENTITIES[entity]
    judged = maps(spark, sf_dir, name, key, raw, normalized)
    return judged, clean.clean_entities(judged, entity, judged.filter("row_id % 10 = 0"), "row_id")


OWN_SQL = """with s as (select 'organization' as entity, s_suppkey as k, 'crm' as external_system, case when k % 5 = 0 then 'N' || k else 'X' || k end as external_id,
    case k % 4 when 0 then 'Own ' || k when 1 then null else case when k % 3 <> 0 then 'Raw ' || k end end as first_value, '-' as second_value from supplier
  union all select 'affiliation', o_orderkey, case when o_orderkey % 2 = 0 then 'other' else 'crm' end, 'X' || o_orderkey, case when o_orderkey % 6 = 0 then 'C0' when o_orderkey % 3 <> 0 then 'C' || o_custkey end, 'O' || (o_orderkey % 9) from orders
  union all select 'event', p_partkey, 'crm', 'X' || p_partkey, nullif(trim(case when p_partkey % 2 = 0 then p_name || ' day' else p_name end), ''), '-' from part),
ok as (select * from s where k % 7 <> 0), kept as (select * from ok where first_value is not null and k % 10 <> 0)"""


@query(OWN_SQL + " select entity, k as row_id, external_system, external_id, first_value, second_value from kept")
def clean_promotion_entities(spark, sf_dir):
    out = None
    for entity in ENTITIES:
        keys = list(clean.REQUIRED[entity])
        rows = promoted(spark, sf_dir, entity)[1]
        shown = rows.select(F.lit(entity).alias("entity"), "row_id", "external_system", "external_id", F.col("payload")[keys[0]].alias("first_value"), F.col(keys[1]).alias("second_value") if len(keys) > 1 else F.lit("-").alias("second_value"))
        out = shown if out is None else out.unionByName(shown)
    return out


@query(OWN_SQL + " select o.entity, considered, coalesce(promoted, 0) as promoted, considered - coalesce(promoted, 0) as skipped from (select entity, count(*) as considered from ok group by 1) o left join (select entity, count(*) as promoted from kept group by 1) p on p.entity = o.entity")
def clean_promotion_counts(spark, sf_dir):
    out = None
    for entity in ENTITIES:
        row = clean.promotion_counts(*promoted(spark, sf_dir, entity)).select(F.lit(entity).alias("entity"), "considered", "promoted", "skipped")
        out = row if out is None else out.unionByName(row)
    return out


GENDERS = ("male", "female", "non_binary", "prefer_not_to_say", "other")
RACES = ("white", "black_or_african_american", "asian", "hispanic_or_latino", "native_american", "pacific_islander", "two_or_more", "prefer_not_to_say", "other")
EDUCATION = ("less_than_high_school", "high_school", "some_college", "associates", "bachelors", "masters", "doctorate", "professional", "other")
SENT = {
    "first_name": "concat('F', c_custkey % 9)", "last_name": "concat(' L', c_custkey % 7)", "middle_name": "case when c_custkey % 3 = 0 then ' M ' end", "preferred_name": "case when c_custkey % 4 = 0 then ' ' end",
    "type": "case when c_custkey % 5 = 0 then 'Volunteer' end", "title": "case when c_custkey % 2 = 0 then concat('Title ', c_custkey % 13) end", "internal_notes": "cast(null as varchar(9))",
    "do_not_call": "case c_custkey % 4 when 0 then 'Yes' when 1 then 'no' end", "do_not_email": "case when c_custkey % 7 = 0 then 'ON' end", "do_not_contact": "cast(null as varchar(9))",
    "birthdate": "case c_custkey % 3 when 0 then '1980-02-03T00:00:00Z' when 1 then 'soon' end", "gender": "case c_custkey % 4 when 0 then 'Male' when 1 then ' FEMALE ' else 'x' end", "race": "case when c_custkey % 2 = 0 then 'Asian' end",
    "education": "case when c_custkey % 6 = 0 then 'Masters' end", "first_volunteer_date": "case when c_custkey % 2 = 0 then '2020-01-05' end", "last_volunteer_date": "cast(null as varchar(9))",
    "department": "case when c_custkey % 4 = 0 then 'Dep' end", "description": "case when c_custkey % 5 = 0 then concat('About ', c_custkey) end", "skills_text": "case when c_custkey % 6 = 0 then ' Cooking ' end",
}
STORED = {
    "first_name": "'Core'", "last_name": "s_name", "middle_name": "'Mid'", "preferred_name": "cast(null as varchar(9))", "type": "cast(null as varchar(9))", "title": "'Old'", "internal_notes": "'note'", "do_not_call": "true", "do_not_email": "true", "do_not_contact": "true",
    "birthdate": "date'1970-01-01'", "gender": "'other'", "race": "cast(null as varchar(9))", "education_level": "'other'", "first_volunteer_date": "date'2019-01-01'", "last_volunteer_date": "date'2019-06-01'", "notes": "'old'",
}
STORED_CONTACTS_SQL = f"""with d as (select * from ({CONTACTS_SQL}) z), p as (select c_custkey as seq, {', '.join(f'{v} as {k}' for k, v in SENT.items())} from customer), top as (select max(s_suppkey) as t from supplier),
r as (select case when load_action = 'inserted' then t + p.seq else entity_id end as entity_id, p.seq, first_name, trim(last_name) as last_name, trim(middle_name) as middle_name, type, title, coalesce(do_not_call, '') = 'Yes' as do_not_call, coalesce(do_not_email, '') = 'ON' as do_not_email,
  case when birthdate <> 'soon' then date '1980-02-03' end as birthdate, case when lower(trim(gender)) in ('male', 'female') then lower(trim(gender)) end as gender, lower(race) as race, lower(education) as education_level, cast(first_volunteer_date as date) as first_volunteer_date,
  nullif(concat_ws(chr(10), coalesce(description, 'Department: ' || department), 'Skills: ' || trim(skills_text)), '') as notes from d join p on p.seq = d.seq, top where load_action in ('inserted', 'updated', 'no_change')),
l as (select entity_id, arg_max(first_name, seq) as first_name, arg_max(last_name, seq) as last_name, arg_max(do_not_call, seq) as do_not_call, arg_max(do_not_email, seq) as do_not_email,
  {', '.join(f'arg_max({c}, seq) filter ({c} is not null) as {c}' for c in ('middle_name', 'type', 'title', 'birthdate', 'gender', 'race', 'education_level', 'first_volunteer_date', 'notes'))} from r group by 1),
c as (select s_suppkey as entity_id, 'core' as source, {', '.join(f'{v} as {k}' for k, v in STORED.items())} from supplier)
select coalesce(c.entity_id, l.entity_id) as entity_id, case when l.entity_id is not null then 'salesforce' else source end as source, case when l.entity_id is not null then l.first_name else c.first_name end as first_name, case when l.entity_id is not null then l.last_name else c.last_name end as last_name,
  case when l.entity_id is not null then l.do_not_call else c.do_not_call end as do_not_call, case when l.entity_id is not null then l.do_not_email else c.do_not_email end as do_not_email, l.entity_id is null as do_not_contact,
  {', '.join(f'coalesce(l.{x}, c.{x}) as {x}' for x in ('middle_name', 'type', 'title', 'gender', 'race', 'education_level', 'notes'))}, {', '.join(f"strftime(coalesce(l.{x}, c.{x}), '%Y-%m-%d') as {x}" for x in ('birthdate', 'first_volunteer_date'))},
  c.preferred_name, c.internal_notes, strftime(c.last_volunteer_date, '%Y-%m-%d') as last_volunteer_date from c full join l on l.entity_id = c.entity_id"""


@query(STORED_CONTACTS_SQL)
def crm_stored_contacts(spark, sf_dir):
    people = view(spark, sf_dir, "supplier", PEOPLE)
    decided = crm_load.contacts(view(spark, sf_dir, "customer", CONTACTS), entry_rows(spark, sf_dir, "contact"), people.select("entity_id", "name"), people.select("mail")).select("seq", "load_action", "entity_id")
    sent = view(spark, sf_dir, "customer", ["c_custkey as seq", *[f"{v} as {k}" for k, v in SENT.items()]])
    core = view(spark, sf_dir, "supplier", ["s_suppkey as entity_id", "'core' as source", *[f"{v} as {k}" for k, v in STORED.items()]])
    out = crm_load.stored_contacts(core, decided.join(sent, "seq"), GENDERS, RACES, EDUCATION)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("birthdate", "first_volunteer_date", "last_volunteer_date")})


SAMPLED = ["c_custkey as person_id", "case when c_custkey % 5 <> 0 then c_name end as first_name", "case when c_custkey % 3 <> 0 then c_mktsegment else '' end as last_name", "case when c_custkey % 4 = 0 then 'm' end as email", "case when c_custkey % 92 = 0 then 'p' end as phone", f"{BIRTH} as birth"]


@query(f"""with {sql_view('c', 'customer', SAMPLED)}, g as (select *, (first_name is not null)::int + (last_name <> '')::int + (email is not null)::int + (phone is not null)::int as n from c),
f as (select person_id, round(n * 100.0 / 4, 2) as score, case when n = 4 then 'high' when n >= 2 then 'medium' else 'low' end as level, concat_ws('; ', case when email is null and phone is null then 'Missing both email and phone' end, case when first_name is null or last_name = '' then 'Missing required name fields' end,
  case when year(birth) < 1900 then 'Unusually old birthdate' end, case when birth > date '{AS_OF}' then 'Future birthdate' end, case when n < 2 then 'Low completeness score' end) as reasons, md5('3:' || person_id) as a, md5('4:' || person_id) as b from g),
r as (select *, row_number() over (partition by level order by a, person_id) as rn, row_number() over (partition by reasons <> '' order by b, person_id) as en from f),
u as (select *, 0 as round from r where rn <= case level when 'medium' then 20 else 15 end union all select *, 1 from r where reasons <> '' and en <= 10 and rn > case level when 'medium' then 20 else 15 end),
k as (select * from u order by round, case when round = 1 then b end, a, person_id limit 50) select person_id, score, level, reasons, reasons <> '' as is_edge from k""")
def sample_report(spark, sf_dir):
    rows = sampling.with_completeness(view(spark, sf_dir, "customer", SAMPLED), ["first_name", "last_name", "email", "phone"])
    checks = sampling.person_checks(F.col("email").isNotNull(), F.col("phone").isNotNull(), F.col("first_name"), F.col("last_name"), F.col("birth"), F.to_date(F.lit(AS_OF)))
    rows = rows.withColumn("reasons", sampling.edge_reasons([*checks, sampling.low_score(F.col("score"))]))
    return sampling.sample_report(rows, "person_id", 50, 3).select("person_id", "score", "level", F.array_join("reasons", "; ").alias("reasons"), "is_edge")


@query("select c_custkey as person_id, coalesce(h, 0.0) as total_hours from customer left join (select o_custkey, sum(l_quantity)::double as h from orders join lineitem on l_orderkey = o_orderkey where l_returnflag <> 'R' group by 1) on o_custkey = c_custkey")
def hours_written_back(spark, sf_dir):
    done = view(spark, sf_dir, "orders", ["o_orderkey", "o_custkey as person_id"]).join(view(spark, sf_dir, "lineitem", ["l_orderkey as o_orderkey", "l_quantity as hours", "l_returnflag"]).filter("l_returnflag <> 'R'"), "o_orderkey")
    return reports.total_hours(view(spark, sf_dir, "customer", ["c_custkey as person_id", "c_acctbal as total_hours"]), done, "person_id").select("person_id", "total_hours")


BORN = f"case when c_custkey % 8 <> 0 then {BIRTH} end as birth"


@query(f"with c as (select c_custkey, {BORN} from customer), a as (select c_custkey, datediff('year', birth, date '{AS_OF}') - (strftime(birth, '%m%d') > '0130')::int as years from c) select c_custkey as person_id, case when years <= 12 then 'child' when years <= 17 then 'teen' when years <= 64 then 'adult' when years is not null then 'senior' end as age_group from a")
def age_groups_written_back(spark, sf_dir):
    people = view(spark, sf_dir, "customer", ["c_custkey as person_id", "'old' as age_group", BORN])
    return reports.age_groups(people, "birth", F.to_date(F.lit(AS_OF))).select("person_id", "age_group")


@query("""with s as (select event_id, user_id, case when event_id % 9 = 0 then null else user_id end as primary_id, event_type from events where event_type <> 'error'),
r as (select c_custkey, timestamp '2024-01-30 00:00:00' - to_minutes(c_custkey * 7 % 4000) as made from customer where c_custkey % 10 <> 0),
j as (select epoch(timestamp '2024-01-30 00:00:00' - made) / 3600 as h from s join r on c_custkey = user_id where primary_id is not null)
select count(*) filter (h < 24) as under_24h, count(*) filter (h >= 24 and h < 48) as "24h_to_48h", count(*) filter (h >= 48) as over_48h from j""")
def run_aging(spark, sf_dir):
    suggestions = view(spark, sf_dir, "events", ["user_id as run_id", "case when event_id % 9 = 0 then null else user_id end as primary_id", "case when event_type = 'error' then 'rejected' else 'pending' end as decision"])
    runs = view(spark, sf_dir, "customer", ["c_custkey as run_id", f"timestamp'{AS_OF} 00:00:00' - make_dt_interval(0, 0, cast(c_custkey * 7 % 4000 as int)) as created_at"]).filter("run_id % 10 <> 0")
    return merge.run_aging(suggestions, runs, F.to_timestamp(F.lit(AS_OF)))
