"""Queries of the services around imports: runs, violations, skips, exports, lookups, merges; with SQL that gives the same rows.

Adapters are lists of expressions that both engines read alike; what the operators do is written once more in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import scalar
from kinfold.operators import completeness, dq, load, match, merge, remediate, reports, runs, sampling, search, survivorship
from kinfold.registry import query, table
from kinfold.sources import exports


def view(spark, sf_dir, name: str, columns: list[str]):
    return table(spark, sf_dir, name).selectExpr(*columns)


def sql_view(alias: str, name: str, columns: list[str]) -> str:
    return f"{alias} as (select {', '.join(columns)} from {name})"


RUNS = [
    "o_orderkey as run_id", "o_orderpriority as source", "case o_orderstatus when 'F' then 'succeeded' when 'O' then 'running' else 'failed' end as status", "o_orderkey % 3 = 0 as dry_run",
    "o_orderdate as started_at", "case when o_orderstatus <> 'O' then o_orderdate + interval 90 minute end as finished_at", "'csv' as adapter", "concat('order ', o_custkey) as notes",
    """concat('{"staging": {"volunteers": {"rows_staged": ', o_custkey, '}}, "core": {"volunteers": {"rows_created": ', o_orderkey % 11, ', "rows_updated": ', o_custkey % 5, '}}}') as counts_json""",
    """concat('{"file_path": "/in/', o_orderkey % 7, '.csv", "keep_file": ', case when o_orderkey % 2 = 0 then 'true' else 'false' end, '}') as ingest_params""",
]
VIOLATIONS = [
    "l_orderkey * 10 + l_linenumber as violation_id", "l_orderkey as run_id", "concat('RULE_', l_returnflag) as rule_code", "case when l_linestatus = 'F' then 'error' else 'warning' end as severity",
    "case l_linenumber when 1 then 'fixed' when 2 then 'suppressed' else 'open' end as status", "l_shipdate as created_at", "concat('=part ', l_partkey) as message", "concat('supplier-', l_suppkey) as record_key",
]
SUGGESTIONS = [
    "event_id as suggestion_id", "user_id as run_id", "case when event_id % 9 = 0 then null else user_id end as primary_id", "user_id + event_id + 1 as candidate_id", "case when event_id % 13 = 0 then null else round(value, 2) end as score",
    "case event_id % 4 when 0 then 'auto_merged' when 1 then 'deferred' else 'pending' end as decision", "case when event_id % 3 = 0 then 'high' else 'review' end as match_type", "ts as created_at",
]
R, V, S = sql_view("r", "orders", RUNS), sql_view("v", "lineitem", VIOLATIONS), sql_view("s", "events", SUGGESTIONS)
RUN_FILTER = runs.Filters(status=("failed", "succeeded"), dry_run=False, since="1996-01-01", until="6/30/1997", search="7")
RUN_WHERE = "status in ('failed', 'succeeded') and not dry_run and started_at >= date '1996-01-01' and started_at < date '1997-07-01' and (contains(lower(source), '7') or contains(adapter, '7') or contains(lower(notes), '7') or run_id = 7)"


@query(f"with {R} select run_id, status from r where {RUN_WHERE}")
def run_filters(spark, sf_dir):
    return runs.filter_runs(view(spark, sf_dir, "orders", RUNS), RUN_FILTER.checked(("failed", "succeeded", "running"))).select("run_id", "status")


@query(f"with {R}, f as (select *, count(*) over () as total from r where status = 'failed') select run_id, total, cast(ceil(total / 20.0) as bigint) as pages from f order by started_at desc, run_id limit 20 offset 40")
def run_page_with_total(spark, sf_dir):
    failed = runs.filter_runs(view(spark, sf_dir, "orders", RUNS), runs.Filters(status=("failed",)))
    return runs.page_with_total(failed, "-started", {"started": "started_at"}, "run_id", 3, 20).select("run_id", "total", "pages")


@query(f"with {V} select violation_id, rule_code from v where status = 'open' and severity = 'error' and rule_code in ('RULE_A', 'RULE_N') and created_at <= timestamp '1999-12-31 23:59:59.999999' and (contains(lower(message), 'part 15') or contains(record_key, 'part 15') or contains(lower(rule_code), 'part 15'))")
def violation_filters(spark, sf_dir):
    f = runs.Filters(status=("open",), until="1999-12-31", search="PART 15")
    return runs.filter_violations(view(spark, sf_dir, "lineitem", VIOLATIONS), f, rules=("RULE_A", "RULE_N"), severities=("error",)).select("violation_id", "rule_code")


@query("select o_orderkey as id, concat('Row_', o_custkey) as record_key from orders where contains(concat('row_', o_custkey), 'w_12') and o_orderpriority = '5-LOW'")
def skip_search(spark, sf_dir):
    rows = view(spark, sf_dir, "orders", ["o_orderkey as id", "o_orderpriority as skip_type", "concat('Row_', o_custkey) as record_key"])
    return runs.filter_skips(rows, "W_12", ("5-LOW",)).select("id", "record_key")


@query(f"""with {R}, {S}, d as (select run_id, count(*) filter (decision = 'auto_merged') as a, count(*) filter (decision = 'pending') as p from s group by 1)
select r.run_id, source, status, dry_run, epoch(coalesce(finished_at, timestamp '2003-01-01') - started_at) as duration_seconds,
  o_custkey as rows_staged, 0 as rows_validated, 0 as rows_quarantined, o_orderkey % 11 as rows_created, o_custkey % 5 as rows_updated, 0 as rows_reactivated, 0 as rows_skipped_duplicates, 0 as rows_skipped_no_change,
  0 as rows_deduped_auto, 0 as rows_missing_external_id, 0 as rows_soft_deleted, o_custkey % 5 as rows_changed, r.run_id % 2 = 0 and r.run_id % 7 in (1, 4) as can_retry, coalesce(a, 0) as rows_dedupe_auto, coalesce(p, 0) as rows_dedupe_manual_review
from r join orders on o_orderkey = r.run_id left join d on d.run_id = r.run_id""")
def run_summaries(spark, sf_dir):
    at = F.to_timestamp(F.lit("2003-01-01 00:00:00"))
    return runs.run_summaries(view(spark, sf_dir, "orders", RUNS), view(spark, sf_dir, "events", SUGGESTIONS), at, ["/in/1.csv", "/in/4.csv"])


@query(f"with {S} select run_id, decision, count(*) as n from s group by 1, 2")
def dedupe_counts_by_run(spark, sf_dir):
    return runs.decisions_by_run(view(spark, sf_dir, "events", SUGGESTIONS))


@query(f"with {R} select r.run_id, r.started_at, (select count(*) from lineitem where l_orderkey = r.run_id) as clean_rows from r order by r.run_id desc limit 5")
def clean_rows_of_latest_runs(spark, sf_dir):
    return runs.clean_rows_of_latest(view(spark, sf_dir, "orders", RUNS), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")))


@query(f"with {R} select run_id, status from r where run_id = (select max(run_id) from r where source = '5-LOW')")
def latest_scan_run(spark, sf_dir):
    return runs.latest_run(view(spark, sf_dir, "orders", RUNS), "5-LOW").select("run_id", "status")


@query("select event_id as map_id, case when user_id = 8 then 'run' else 'seen' end as found_by from events where user_id = 8 or ts >= timestamp '2024-01-25'")
def touched_map_entries(spark, sf_dir):
    rows = view(spark, sf_dir, "events", ["event_id as map_id", "user_id as run_id", "ts as last_seen_at"])
    return runs.touched_maps(rows, 8, F.to_timestamp(F.lit("2024-01-25 00:00:00"))).select("map_id", "found_by")


MERGE_LOG = ["event_id as merge_id", "case when event_id % 2 = 0 then concat('{\"suggestion_id\": ', event_id % 500, '}') else '{}' end as undo_payload"]


@query(f"""with {S}, l as (select event_id % 500 as sid, max(event_id) as merge_id from events where event_id % 2 = 0 group by 1)
select suggestion_id, p.c_name as primary_name, c.c_name as candidate_name, case when decision = 'auto_merged' then merge_id end as merge_id
from s left join customer p on p.c_custkey = primary_id left join customer c on c.c_custkey = candidate_id left join l on sid = suggestion_id""")
def review_rows_with_names(spark, sf_dir):
    people = view(spark, sf_dir, "customer", ["c_custkey as person_id", "c_name as name"])
    return runs.with_review_names(view(spark, sf_dir, "events", SUGGESTIONS), people, view(spark, sf_dir, "events", MERGE_LOG)).select("suggestion_id", "primary_name", "candidate_name", "merge_id")


FIELD_STATS = ["concat('f', n_nationkey) as field", "case when n_nationkey % 4 = 0 then null else concat('t', n_regionkey) end as target", "cast(n_nationkey as bigint) as mapped", "n_nationkey / 40.0 as population_rate"]
FS = sql_view("f", "nation", FIELD_STATS)


@query(f"with {FS} select count(target) as mapped_fields, count(*) - count(target) as unmapped_fields, round(avg(population_rate) filter (target is not null), 3) as average_population from f")
def population_overview(spark, sf_dir):
    return runs.population_overview(view(spark, sf_dir, "nation", FIELD_STATS))


@query(f"with {FS} select target, array_to_string(list_sort(list(distinct field)), ',') as contributors, sum(mapped)::bigint as filled, round(least(1.0, sum(mapped) / 100.0), 4) as completeness_rate from f where target is not null group by 1")
def target_contributors(spark, sf_dir):
    return runs.target_contributors(view(spark, sf_dir, "nation", FIELD_STATS), F.lit(100)).withColumn("contributors", F.array_join("contributors", ","))


@query("with h as (select event_type as object_name, count(*) as loaded from events group by 1), e as (select * from (values ('click', 100), ('missing', 7)) e(object_name, expected)) select object_name, coalesce(expected, 0) as expected, coalesce(loaded, 0) as loaded, coalesce(expected, 0) - coalesce(loaded, 0) as missing, coalesce(expected, 0) = coalesce(loaded, 0) as matches from e full join h using (object_name)")
def source_count_check(spark, sf_dir):
    expected = spark.createDataFrame([("click", 100), ("missing", 7)], "object_name string, expected long")
    return runs.source_count_check(table(spark, sf_dir, "events").select(F.col("event_type").alias("object_name")), expected)


# --- exports ------------------------------------------------------------------------------------------------------


@query(f"""with {V} select violation_id, run_id, rule_code, severity, status, record_key, '''' || message as message, 'a=' || violation_id || '; b=x' as details, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at
from v where status = 'open' and severity = 'error' and run_id % 5 = 0 order by created_at desc, violation_id desc limit 5000""")
def violation_export(spark, sf_dir):
    """Open errors of the runs of one source."""
    rows = view(spark, sf_dir, "lineitem", VIOLATIONS).filter("status = 'open' and severity = 'error' and run_id % 5 = 0")
    return exports.violation_export(rows.withColumn("details", F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("violation_id").cast("string"))))


METRICS = ["o_orderpriority as entity", "o_orderstatus as field", "o_custkey as total", "o_custkey - o_custkey % 7 as filled", "(o_custkey - o_custkey % 7) * 100.0 / (o_custkey + 1) as pct", "'good' as status"]


@query(f"with {sql_view('m', 'orders', METRICS)} select entity as entity_type, field as field_name, total as total_records, filled as records_with_value, total - filled as records_without_value, round(pct, 2) as completeness_percentage, status from m")
def metrics_export(spark, sf_dir):
    return exports.metrics_export(view(spark, sf_dir, "orders", METRICS))


@query("select 'part' as entity, p_partkey as record_id, p_name as name, round(p_retailprice / 7, 2) as score, case when p_size < 10 and p_size % 2 = 0 then 'small; even' when p_size < 10 then 'small' when p_size % 2 = 0 then 'even' else '' end as edge_case_reasons from part")
def samples_export(spark, sf_dir):
    reasons = sampling.edge_reasons([("small", F.col("p_size") < 10), ("even", F.col("p_size") % 2 == 0)])
    rows = table(spark, sf_dir, "part").select(F.lit("part").alias("entity"), F.col("p_partkey").alias("record_id"), F.col("p_name").alias("name"), (F.col("p_retailprice") / 7).alias("score"), reasons.alias("reasons"))
    return exports.samples_export(rows, ["name"])


@query(f"with {S} select suggestion_id, run_id, primary_id, candidate_id, score, match_type, decision, created_at from s order by score desc nulls last, suggestion_id limit 10000")
def queue_export(spark, sf_dir):
    return exports.queue_export(view(spark, sf_dir, "events", SUGGESTIONS))


@query("""select '{"run_id":7,"dry_run":false,"diff":"updated","counts":{"rows_created":0,"rows_updated":' || count(*) filter (o_orderstatus = 'F') || ',"rows_reactivated":' || count(*) filter (o_orderstatus = 'P') || '}}' as artifact from orders""")
def run_artifact(spark, sf_dir):
    s = F.col("o_orderstatus")
    changes = table(spark, sf_dir, "orders").agg(F.lit(0).alias("rows_created"), F.count_if(s == "F").alias("rows_updated"), F.count_if(s == "P").alias("rows_reactivated"))
    return exports.run_artifact(changes, 7, False)


# --- lookups ------------------------------------------------------------------------------------------------------

LINKS = ["l_suppkey as person_id", "l_partkey as organization_id", "l_orderkey as event_id", "case when l_linestatus = 'F' then l_shipdate end as end_date", "case l_returnflag when 'A' then 'cancelled' when 'N' then 'confirmed' else 'invited' end as status", "concat('role', l_linenumber) as role", "l_linenumber = 1 as is_primary"]
L = sql_view("l", "lineitem", LINKS)
PERSONS = ["s_suppkey as person_id", "s_name as name", "case when s_nationkey % 3 = 0 then 'inactive' else 'active' end as status"]
P = sql_view("p", "supplier", PERSONS)


@query(f"with {L}, {P} select person_id, name from p where status = 'active' and exists (select 1 from l where l.person_id = p.person_id and organization_id = 17 and end_date is null)")
def active_volunteers_of_organization(spark, sf_dir):
    return search.active_volunteers(view(spark, sf_dir, "supplier", PERSONS), view(spark, sf_dir, "lineitem", LINKS), 17).select("person_id", "name")


@query(f"with {L}, {P} select distinct p.person_id, name, role from p join l on l.person_id = p.person_id where event_id = 33 and l.status <> 'cancelled'")
def event_people_by_role(spark, sf_dir):
    return search.event_people(view(spark, sf_dir, "supplier", PERSONS), view(spark, sf_dir, "lineitem", LINKS), 33).select("person_id", "name", "role")


@query(f"with {L} select event_id, count(distinct person_id) filter (status = 'confirmed') as confirmed from l group by 1")
def confirmed_attendance(spark, sf_dir):
    return search.attendance(view(spark, sf_dir, "lineitem", LINKS))


@query(f"with {L} select count(*) as total, count(*) filter (end_date is null) as active, count(*) filter (is_primary) as \"primary\" from l")
def affiliation_link_counts(spark, sf_dir):
    return completeness.link_counts(view(spark, sf_dir, "lineitem", LINKS))


@query(f"with {P} select person_id, name from p where person_id in (select l_suppkey from lineitem where l_linenumber = 1 and l_quantity = 7)")
def people_by_primary_value(spark, sf_dir):
    values = view(spark, sf_dir, "lineitem", ["l_suppkey as person_id", "l_linenumber = 1 as is_primary", "l_quantity as value"])
    return search.by_primary_value(view(spark, sf_dir, "supplier", PERSONS), values, "value", 7.0).select("person_id", "name")


MEMBERS = ["user_id", "event_id % 25 as organization_id", "event_type <> 'error' as is_active"]


@query("select n_nationkey as id, n_name as name from nation where n_regionkey <> 2 and n_nationkey in (select event_id % 25 from events where user_id = 8 and event_type <> 'error')")
def visible_organizations(spark, sf_dir):
    rows = view(spark, sf_dir, "nation", ["n_nationkey as id", "n_name as name", "n_regionkey <> 2 as is_active"])
    return search.visible_organizations(rows, view(spark, sf_dir, "events", MEMBERS), 8).select("id", "name")


@query("select c_custkey as person_id, max_by(props, (ts, cast(event_id as varchar))) as metadata from customer left join events on user_id = c_custkey and event_type <> 'error' group by 1")
def contact_map_metadata(spark, sf_dir):
    maps = view(spark, sf_dir, "events", ["user_id as entity_id", "case when event_type = 'error' then 'event' else 'contact' end as entity_type", "'crm' as external_system", "cast(event_id as string) as external_id", "ts as last_seen_at", "props as metadata"])
    return search.map_metadata(view(spark, sf_dir, "customer", ["c_custkey as person_id"]), maps)


@query("""select 'HOURS_POSITIVE' as rule, 'hours' as "table", cast(o_orderkey as varchar) as row_id from orders where o_totalprice - 1000 <= 0 union all
select 'END_AFTER_START', 'slots', cast(event_id as varchar) from events where ts - interval 3 day <= timestamp '2024-01-05' union all
select 'FIELD_NAMED', 'changes', cast(doc_id as varchar) from documents where doc_id % 3 = 0""")
def integrity_violations(spark, sf_dir):
    tables = {
        "hours": view(spark, sf_dir, "orders", ["o_orderkey as hour_id", "o_totalprice - 1000 as hours"]),
        "slots": view(spark, sf_dir, "events", ["event_id as slot_id", "timestamp'2024-01-05 00:00:00' as start_time", "ts - interval 3 day as end_time"]),
        "changes": view(spark, sf_dir, "documents", ["doc_id as change_id", "case when doc_id % 3 = 0 then ' ' else lang end as field_name"]),
    }
    return search.integrity_violations(tables, {"hours": "hour_id", "slots": "slot_id", "changes": "change_id"}, F.to_date(F.lit("2024-01-01")))


FORMS = ["o_orderkey as id", "case when o_orderkey % 5 = 0 then 'Bad Slug' else 'good-slug-1' end as slug", "o_totalprice * 4 - 1000 as cost", "o_orderdate as start_date", "o_orderdate + interval 1 day * (o_orderkey % 3 - 1) as registration_deadline"]


@query("""select o_orderkey as id, concat_ws(',', case when o_orderkey % 5 = 0 then 'slug' end, case when o_totalprice * 4 - 1000 < 0 or o_totalprice * 4 - 1000 > 1000000 then 'cost' end,
  case when o_orderdate < date '1996-01-01' then 'start_date' end, case when o_orderkey % 3 >= 1 then 'registration_deadline' end) as errors from orders""")
def event_form_errors(spark, sf_dir):
    rows = view(spark, sf_dir, "orders", FORMS)
    return rows.select("id", F.array_join(search.event_form_errors(F.to_date(F.lit("1996-01-01"))), ",").alias("errors"))


KEYED = ["o_orderpriority as entity", "o_orderstatus as field", "round(sum(o_totalprice), 2) as percent"]


@query("select case when o_orderpriority = '5-LOW' then 'contact' else o_orderpriority end as entity, 'email:' || count(*) filter (o_orderstatus = 'F') || case when o_orderpriority = '5-LOW' then '' else ',middle:' || count(*) filter (o_orderstatus = 'O') end as metrics from orders group by o_orderpriority")
def key_metrics(spark, sf_dir):
    entity = F.when(F.col("o_orderpriority") == "5-LOW", "contact").otherwise(F.col("o_orderpriority")).alias("entity")
    field = F.create_map(F.lit("F"), F.lit("email"), F.lit("O"), F.lit("middle"))[F.col("o_orderstatus")].alias("field")
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus in ('F', 'O')").groupBy(entity, field).agg(F.count(F.lit(1)).alias("percent"))
    return completeness.key_metrics(rows).select("entity", F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("metrics"))


@query("""select cast(doc_id as varchar) as record_id, '{"event_id":' || doc_id || ',"title":"' || source || '","description":"' || case when length(d) > 100 then left(d, 100) || '...' else d end || '","start_date":null,"status":null}' as record from (select doc_id, source, repeat(lang, cast(doc_id % 60 + 1 as int)) as d from documents)""")
def serialized_records(spark, sf_dir):
    return sampling.serialized(view(spark, sf_dir, "documents", ["doc_id as event_id", "source as title", "repeat(lang, cast(doc_id % 60 + 1 as int)) as description"]), "event")


@query("with e as (select min(o_totalprice) as a, max(o_totalprice) as b from orders) select cast(least(9, floor((o_totalprice - a) / (b - a) * 10)) as int) as bin, count(*) as n from orders, e group by 1")
def value_distribution(spark, sf_dir):
    return sampling.distribution(table(spark, sf_dir, "orders"), "o_totalprice")


# --- merges and survivorship --------------------------------------------------------------------------------------

PEOPLE = ["c_custkey as person_id", "c_name as first_name", "case when c_custkey % 3 = 0 then null else c_mktsegment end as last_name", "case when c_custkey % 4 = 0 then null else concat('mail', c_custkey) end as email", "case when c_custkey % 5 = 0 then ' ' else concat('note ', c_nationkey) end as notes"]
C = sql_view("c", "customer", PEOPLE)
DETAIL_FIELDS = ("first_name", "last_name", "email", "notes")


def detail_sql(f: str) -> str:
    a, b = (f"nullif(trim({side}.{f}), '')" for side in ("p", "k"))
    return f"'{f}:' || coalesce({a}, {b}, '-') || ':' || case when {a} is not null then 'primary' when {b} is not null then 'candidate' else '-' end"


@query(f"with {S}, {C} select suggestion_id, {' || chr(59) || '.join(detail_sql(f) for f in DETAIL_FIELDS)} as preview from s join c p on p.person_id = primary_id join c k on k.person_id = candidate_id")
def candidate_details(spark, sf_dir):
    shown = merge.candidate_details(view(spark, sf_dir, "events", SUGGESTIONS), view(spark, sf_dir, "customer", PEOPLE))
    text = F.transform("preview", lambda x: F.concat_ws(":", x["field"], F.coalesce(x["value"], F.lit("-")), F.coalesce(x["side"], F.lit("-"))))
    return shown.select("suggestion_id", F.array_join(text, ";").alias("preview"))


@query(
    """with recursive f as (select c_custkey as candidate, cast(floor(c_custkey / 2) as bigint) as parent from customer where c_custkey % 3 <> 0 and c_custkey > 0),
up(candidate, place, parent) as (select candidate, candidate, parent from f union all select up.candidate, f.candidate, f.parent from up join f on f.candidate = up.parent)
select candidate as candidate_id, min(parent) as primary_id from up group by 1"""
)
def merge_chains(spark, sf_dir):
    """Each person is to be merged into the one of half its id: whom it ends up in."""
    pairs = view(spark, sf_dir, "customer", ["c_custkey as suggestion_id", "c_custkey as candidate_id", "cast(floor(c_custkey / 2) as bigint) as primary_id"]).filter("candidate_id % 3 <> 0 and candidate_id > 0")
    return merge.resolved_pairs(pairs).select("candidate_id", "primary_id")


SURVIVORS = ["c_custkey as id", "case when c_custkey % 7 = 0 then 'set by hand' end as manual_first_name", "c_name as incoming_first_name", "c_mktsegment as existing_core_first_name", "case when c_custkey % 2 = 0 then 'v@x.org' end as verified_core_email", "concat('m', c_custkey) as incoming_email", "case when c_custkey % 3 = 0 then null else 'old@x.org' end as existing_core_email"]


@query("""select 2 * count(*) as decisions, count(*) + count(*) filter (c_custkey % 2 <> 0 or c_custkey % 3 = 0 or true) as changed, cast(0 as bigint) as kept, count(*) filter (c_custkey % 7 = 0) as manual_wins, count(*) filter (c_custkey % 2 = 0) as verified_wins,
  count(*) filter (c_custkey % 7 <> 0) + count(*) filter (c_custkey % 2 <> 0) as incoming_wins, cast(0 as bigint) as core_wins, cast(0 as bigint) as "empty" from customer""")
def survivorship_totals(spark, sf_dir):
    resolved = survivorship.apply_survivorship(view(spark, sf_dir, "customer", SURVIVORS), keep=("id",))
    return survivorship.survivorship_totals(survivorship.decisions(resolved, ("id",)))


# --- updates of the core, candidates and remediation --------------------------------------------------------------

UPDATES = [
    "o_orderkey as clean_id", "o_custkey as entity_id", "case o_orderstatus when 'F' then 'updated' when 'O' then 'deterministic_update' else 'reactivated' end as load_action", "case when o_orderkey % 50 = 0 then 'crm' else 'csv' end as external_system",
    "case when o_orderkey % 3 = 0 then ' ' else concat('Ann', o_orderkey % 2) end as first_name", "case when o_orderkey % 4 = 0 then null else concat('mail', o_orderkey % 3) end as email",
]
STOCK = ["c_custkey as person_id", "'csv' as source", "c_custkey % 5 = 0 as email_verified", "case when c_custkey % 2 = 0 then 'Ann0' end as first_name", "case when c_custkey % 7 = 0 then null else 'mail1' end as email"]
UPDATES_SQL = f"""with {sql_view('u', 'orders', UPDATES)}, {sql_view('c', 'customer', STOCK)},
x as (select clean_id, entity_id, load_action, unnest(['first_name', 'email', 'source']) as field, unnest([nullif(trim(u.first_name), ''), case when not (email_verified and c.email is not null) then nullif(trim(u.email), '') end, external_system]) as new_value,
  unnest([c.first_name, c.email, c.source]) as core_value from u join c on person_id = entity_id),
y as (select *, coalesce(last_value(new_value ignore nulls) over (partition by entity_id, field order by clean_id rows between unbounded preceding and 1 preceding), core_value) as old_value from x),
changes as (select clean_id, entity_id, load_action, field, old_value, new_value from y where new_value is not null and new_value is distinct from old_value)"""


def applied(spark, sf_dir):
    return load.apply_updates(view(spark, sf_dir, "orders", UPDATES), view(spark, sf_dir, "customer", STOCK), ("first_name", "email"))


@query(UPDATES_SQL + " select clean_id, entity_id, field, old_value, new_value from changes")
def core_change_log(spark, sf_dir):
    return applied(spark, sf_dir)[2]


@query(UPDATES_SQL + """ select u.clean_id, case when u.clean_id in (select clean_id from changes) or u.load_action = 'reactivated' then u.load_action when u.load_action = 'updated' then 'skipped_no_change' else 'deterministic_no_change' end as load_action from u join c on person_id = entity_id""")
def core_update_actions(spark, sf_dir):
    return applied(spark, sf_dir)[0].select("clean_id", "load_action")


@query(UPDATES_SQL + """, l as (select entity_id, field, arg_max(new_value, clean_id) filter (new_value is not null) as v from x group by 1, 2), p as (select entity_id, max(v) filter (field = 'first_name') as f, max(v) filter (field = 'email') as e, max(v) filter (field = 'source') as s from l group by 1)
select person_id, coalesce(s, source) as source, case when e is not null and e is distinct from email then false else email_verified end as email_verified, coalesce(f, first_name) as first_name, coalesce(e, email) as email from c left join p on entity_id = person_id""")
def core_after_updates(spark, sf_dir):
    return applied(spark, sf_dir)[1]


def persons(spark, sf_dir, name: str, key: str, ident: str, every: int):
    """People with names, births, postal codes and an address that some share."""
    k = F.col(key)
    given = F.element_at(F.array(*[F.lit(x) for x in ("Annabel", "Annabell", "Anna", "Bob", "Bobby")]), (k % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, name).select(
        k.alias(ident), given.alias("first_name"), F.concat(F.lit("Family"), (k % 40).cast("string")).alias("last_name"), F.when(k % 9 != 0, F.date_format(F.date_add(F.to_date(F.lit("1990-01-01")), (k % 800).cast("int")), "yyyy-MM-dd")).alias("dob"),
        none.alias("street"), none.alias("city"), F.when(k % 4 != 0, (k % 6).cast("string")).alias("postal_code"), none.alias("employer"), none.alias("school"),
        F.when(k % every == 0, F.array(F.concat(F.lit("m"), (k % 30).cast("string"), F.lit("@x.org")))).alias("emails"), F.lit(None).cast("array<string>").alias("phones"),
    )


def person_sql(alias: str, name: str, key: str, ident: str, every: int) -> str:
    return f"""{alias} as (select {key} as {ident}, ['Annabel', 'Annabell', 'Anna', 'Bob', 'Bobby'][cast({key} % 5 + 1 as int)] as f, 'Family' || ({key} % 40) as l, case when {key} % 9 <> 0 then date '1990-01-01' + cast({key} % 800 as int) end as dob,
  case when {key} % 4 <> 0 then cast({key} % 6 as varchar) end as zip, case when {key} % {every} = 0 then 'm' || ({key} % 30) || '@x.org' end as mail from {name})"""


CANDIDATES_SQL = f"""with {person_sql('a', 'customer', 'c_custkey', 'row_id', 3)}, {person_sql('b', 'supplier', 's_suppkey', 'person_id', 5)},
considered as (select *, case when dob is null and zip is null and mail is null then 'skipped_no_signals' when row_id % 10 = 3 then 'skipped_deterministic' else 'compared' end as state from a),
cmp as (select * from considered where state = 'compared'),
direct as (select distinct row_id, person_id from cmp join b on cmp.mail = b.mail or (lower(cmp.l) = lower(b.l) and left(lower(cmp.f), 1) = left(lower(b.f), 1) and cmp.zip = b.zip)),
more as (select row_id, person_id from cmp join b on lower(cmp.l) = lower(b.l) and left(lower(cmp.f), 1) = left(lower(b.f), 1) where row_id not in (select row_id from direct) qualify row_number() over (partition by row_id order by person_id) <= 10),
pairs as (select * from direct union all select * from more),
scored as (select row_id, person_id, round(0.25 * jaro_winkler_similarity(lower(a.f || ' ' || a.l), lower(b.f || ' ' || b.l)) + 0.20 * coalesce(greatest(0.0, 1 - abs(a.dob - b.dob) / 730.0), 0.0) + 0.20 * coalesce((a.mail = b.mail)::int, 0), 4) as score from pairs join a using (row_id) join b using (person_id)),
banded as (select *, case when score >= 0.95 then 'high' when score >= 0.60 then 'review' else 'low' end as match_type from scored)"""


def generated(spark, sf_dir):
    incoming = persons(spark, sf_dir, "customer", "c_custkey", "row_id", 3).withColumn("matched", F.col("row_id") % 10 == 3)
    existing = spark.createDataFrame([], "row_id long, person_id long")
    return match.generate_candidates(incoming, persons(spark, sf_dir, "supplier", "s_suppkey", "person_id", 5), existing)


@query(CANDIDATES_SQL + " select row_id, person_id, score, match_type, 'pending' as decision from banded where match_type <> 'low'")
def fuzzy_candidates(spark, sf_dir):
    return generated(spark, sf_dir)[0].select("row_id", "person_id", "score", "match_type", "decision")


@query(CANDIDATES_SQL + """ select (select count(*) from considered) as rows_considered, (select count(*) from considered where state = 'skipped_no_signals') as skipped_no_signals, (select count(*) from considered where state = 'skipped_deterministic') as skipped_deterministic,
  (select count(*) from cmp where row_id not in (select row_id from pairs)) as skipped_no_candidates, count(*) filter (match_type <> 'low') as suggestions_created, count(*) filter (match_type = 'high') as high_pairs, count(*) filter (match_type = 'review') as review_pairs, count(*) filter (match_type = 'low') as low_pairs from banded""")
def fuzzy_run_summary(spark, sf_dir):
    return generated(spark, sf_dir)[1]


@query("""select o_orderkey as violation_id, case when o_orderstatus = 'P' then 'not_open' when o_orderkey % 4 = 0 then 'validation_failed' else 'succeeded' end as outcome, case when o_orderstatus <> 'P' and o_orderkey % 4 = 0 then 'VOL_EMAIL_FORMAT' else '' end as rule_codes,
  case when o_orderstatus <> 'P' and o_orderkey % 4 <> 0 then case when o_orderkey % 6 = 0 then 'error_missing_external_id' else 'inserted' end end as load_action from orders""")
def remediation_outcomes(spark, sf_dir):
    """Every open row gets a new address, some of them bad ones; what is good is loaded."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    text = lambda s: F.concat(F.lit(s), k.cast("string"))
    payload = F.create_map(F.lit("external_id"), F.when(k % 6 != 0, text("x")), F.lit("first_name"), text("First"), F.lit("last_name"), text("Last"), F.lit("email"), F.lit("broken"))
    violations = table(spark, sf_dir, "orders").select(k.alias("violation_id"), F.when(F.col("o_orderstatus") == "P", "fixed").otherwise("open").alias("status"), payload.alias("payload"))
    edits = table(spark, sf_dir, "orders").select(k.alias("violation_id"), F.create_map(F.lit("email"), F.when(k % 4 == 0, "still broken").otherwise(F.concat(text("m"), F.lit("@x.org"))), F.lit("stray"), F.lit("dropped")).alias("edits"))
    core = spark.createDataFrame([], "person_id long, first_name string, last_name string, email string, phone_e164 string, notes string, email_verified boolean, source string, name string")
    id_map = spark.createDataFrame([], "external_system string, external_id string, entity_id long, is_active boolean")
    done = remediate.remediate(violations, edits, core, id_map, F.to_timestamp(F.lit("2024-01-01")))["results"]
    return done.select("violation_id", "outcome", F.array_join("rule_codes", ",").alias("rule_codes"), "load_action")


# --- further reports and lookups ----------------------------------------------------------------------------------

MAPS = ["event_id as map_id", "lpad(cast(event_id as string), 7, '0') as external_id", "user_id as run_id", "event_type <> 'error' as is_active", "ts as first_seen_at", "case when event_id % 3 = 0 then ts else ts + interval 1 day end as last_seen_at"]


@query("""select count(*) filter (user_id = 8) as touched, count(*) filter (user_id = 8 and event_id % 3 = 0) as "new", count(*) filter (event_type <> 'error') as total_active,
  array_to_string((select list(x order by x) from (select lpad(cast(event_id as varchar), 7, '0') as x from events where user_id = 8 and event_id % 3 = 0 order by 1 limit 5)), ',') as examples from events""")
def id_map_changes(spark, sf_dir):
    return reports.id_map_changes(view(spark, sf_dir, "events", MAPS), F.lit(8)).withColumn("examples", F.array_join("examples", ","))


@query("select count(*) as total, count(*) filter (o_orderstatus <> 'F') as active, count(*) filter (o_orderdate >= timestamp '1998-01-01') as recent, count(*) filter (o_orderdate + interval 5 day >= timestamp '1998-01-24') as logins from orders")
def admin_counters(spark, sf_dir):
    users = view(spark, sf_dir, "orders", ["o_orderstatus <> 'F' as is_active", "o_orderdate as created_at", "o_orderdate + interval 5 day as last_login"])
    return reports.recent_counts(users, F.to_timestamp(F.lit("1998-01-31 00:00:00")))


@query(f"with {V} select distinct rule_code from v")
def distinct_rule_codes(spark, sf_dir):
    return reports.distinct_values(view(spark, sf_dir, "lineitem", VIOLATIONS), "rule_code")


@query("""with e as (select o_orderkey, o_orderpriority as rule_code, o_orderdate as made, case when o_orderkey % 3 = 0 then 'success' else 'validation_failed' end as outcome, unnest(case when o_orderkey % 2 = 0 then ['email'] else ['email', 'phone'] end) as field from orders),
r as (select *, unnest(case when outcome = 'success' then [rule_code] else ['R1', 'R2'] end) as code from e where made >= timestamp '1998-01-01')
select field, outcome, code as rule_code, count(*) as n from r group by 1, 2, 3""")
def remediation_stats(spark, sf_dir):
    k = F.col("o_orderkey")
    diff = F.when(k % 2 == 0, F.create_map(F.lit("email"), F.lit("x"))).otherwise(F.create_map(F.lit("email"), F.lit("x"), F.lit("phone"), F.lit("y")))
    audit = F.array(F.struct(F.col("o_orderdate").cast("timestamp").alias("at"), F.when(k % 3 == 0, "success").otherwise("validation_failed").alias("outcome"), F.array(F.lit("R1"), F.lit("R2")).alias("rule_codes"), diff.alias("diff")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rule_code"), audit.alias("audit"))
    return reports.remediation_stats(rows, F.to_timestamp(F.lit("1998-01-01 00:00:00")))


CHILDREN = ["l_suppkey as person_id", "l_extendedprice as value", "l_linenumber = 1 as is_primary", "struct(l_orderkey, l_partkey, l_linenumber, l_extendedprice) as place"]


@query("select l_suppkey as person_id, arg_min(l_extendedprice, (case when l_linenumber = 1 then 0 else 1 end, l_orderkey, l_partkey, l_linenumber, l_extendedprice)) as value from lineitem group by 1")
def first_or_primary_child(spark, sf_dir):
    return search.first_child(view(spark, sf_dir, "lineitem", CHILDREN), "person_id", "value", F.col("is_primary"), "place")


@query("select n_nationkey, string_agg(s_suppkey || ' ' || s_name, ',' order by s_suppkey) as children from nation left join supplier on s_nationkey = n_nationkey group by 1")
def nested_children(spark, sf_dir):
    nested = search.nested_children(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", table(spark, sf_dir, "supplier"), "s_nationkey", "children", ["s_suppkey", "s_name"])
    return nested.select("n_nationkey", F.array_join(F.transform("children", lambda c: F.concat_ws(" ", c["s_suppkey"].cast("string"), c["s_name"])), ",").alias("children"))


GRANTS = ["n_regionkey as role_id", "n_name as permission"]


@query("""with m as (select distinct user_id, event_id % 25 as organization_id, event_id % 5 as role_id from events where event_type <> 'error'), g as (select n_regionkey as role_id, n_name as permission from nation)
select distinct user_id, organization_id, permission from m join g using (role_id) union select c_custkey, null, permission from customer, g where c_custkey % 40 = 0""")
def role_permissions(spark, sf_dir):
    users = view(spark, sf_dir, "customer", ["c_custkey as user_id", "c_custkey % 40 = 0 as is_super_admin"])
    members = view(spark, sf_dir, "events", ["user_id", "event_id % 25 as organization_id", "cast(event_id % 5 as int) as role_id", "event_type <> 'error' as is_active"])
    return search.permissions_of(users, members, view(spark, sf_dir, "nation", GRANTS))


@query("select n_nationkey as role_id, n_regionkey as level from nation where n_regionkey <= 2")
def roles_up_to_level(spark, sf_dir):
    return search.roles_up_to(view(spark, sf_dir, "nation", ["n_nationkey as role_id", "n_regionkey as level"]), 2)


@query("select n_nationkey as id, n_name as name from nation where n_regionkey <> 2 and (n_name ilike '%ion_1%' or 'x' ilike '%ion_1%') order by n_name, n_nationkey limit 20")
def autocomplete_organizations(spark, sf_dir):
    rows = view(spark, sf_dir, "nation", ["n_nationkey as id", "n_name as name", "'x' as slug", "n_regionkey <> 2 as is_active"])
    return search.autocomplete(rows, "ion_1").select("id", "name")


@query("select c_custkey as person_id from customer where not coalesce(case when c_custkey % 3 = 0 then null else c_custkey % 2 = 0 end, false) and c_custkey % 5 = 0")
def contact_preference_filter(spark, sf_dir):
    rows = view(spark, sf_dir, "customer", ["c_custkey as person_id", "case when c_custkey % 3 = 0 then null else c_custkey % 2 = 0 end as do_not_email", "c_custkey % 5 = 0 as local"])
    return rows.filter(search.preference("do_not_email", False) & search.preference("local", True) & search.preference("do_not_email", None)).select("person_id")


@query("""select o_orderkey as id, concat_ws(',', case when o_orderkey % 7 = 0 then 'EVENT_TITLE_REQUIRED' end, case when o_orderkey % 5 = 0 then 'EVENT_START_DATE_REQUIRED' end, case when o_orderkey % 5 <> 0 and o_orderkey % 3 = 0 then 'EVENT_DATE_VALIDATION' end) as codes from orders""")
def event_rule_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "orders", ["o_orderkey as id", "case when o_orderkey % 7 = 0 then ' ' else 'Fair' end as title", "case when o_orderkey % 5 = 0 then '' else '2024-01-02T10:00:00Z' end as start_date", "case when o_orderkey % 3 = 0 then '2024-01-02T10:00:00Z' else 'later' end as end_date"])
    return dq.judge(rows, dq.event_rules()).select("id", F.array_join(F.transform("violations", lambda v: v["rule_code"]), ",").alias("codes"))


@query("select c_custkey as id, concat_ws(',', case when c_custkey % 4 = 0 then 'AFF_CONTACT_REQUIRED' end, case when c_custkey % 6 = 0 then 'AFF_ORGANIZATION_REQUIRED' end) as codes, case when c_custkey % 4 = 0 or c_custkey % 6 = 0 then 'quarantined' else 'validated' end as status from customer")
def affiliation_rule_violations(spark, sf_dir):
    rows = view(spark, sf_dir, "customer", ["c_custkey as id", "case when c_custkey % 4 = 0 then ' ' else 'c' end as contact_id", "case when c_custkey % 6 = 0 then null else 'o' end as organization_id"])
    return dq.judge(rows, dq.affiliation_rules()).select("id", F.array_join(F.transform("violations", lambda v: v["rule_code"]), ",").alias("codes"), "status")


@query("select c_custkey as id, case c_custkey % 5 when 0 then 'x' || c_custkey when 1 then 's' || c_custkey when 2 then 'seq-' || c_custkey else 'row-' || c_custkey end as record_key from customer")
def record_keys(spark, sf_dir):
    k = F.col("c_custkey")
    key = scalar.record_key(F.when(k % 5 == 0, F.concat(F.lit("x"), k)), F.when(k % 5 == 1, F.concat(F.lit("s"), k)), F.when(k % 5 == 2, k), k)
    return table(spark, sf_dir, "customer").select(k.alias("id"), key.alias("record_key"))


@query("""select c_custkey as id, case c_custkey % 4 when 0 then 'a@x.org' when 1 then 'work@x.org' when 2 then 'plain@x.org' end as email, case c_custkey % 4 when 0 then '1' when 1 then '2' when 2 then 'Plain@X.org' end as phone,
  case c_custkey % 3 when 0 then 'Likes' || chr(10) || 'Skills: SQL' when 1 then 'Department: IT' || chr(10) || 'Skills: SQL' else 'Skills: SQL' end as notes from customer""")
def extracted_contact_fields(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "{'primary': 'A@x.org', 'home': 'b@x.org'}").when(k % 4 == 1, '{"primary": "", "work": "work@x.org"}').when(k % 4 == 2, " Plain@X.org ")
    number = F.when(k % 4 == 0, "{'mobile': '1', 'work': '2'}").when(k % 4 == 1, '{"home": " ", "work": "2"}').when(k % 4 == 2, " Plain@X.org ")
    notes = scalar.compose_notes(F.when(k % 3 < 2, "IT"), F.when(k % 3 == 0, "Likes"), F.lit("SQL"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), scalar.extract_email(raw).alias("email"), scalar.extract_phone(number).alias("phone"), notes.alias("notes"))


@query("select o_orderkey as id, o_orderdate >= date '1996-05-06' as after_first, o_orderdate < date '1997-05-07' as before_last from orders")
def filter_date_bounds(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (day >= scalar.filter_date(F.lit("5/6/1996"))).alias("after_first"), (day <= scalar.filter_date(F.lit("1997-05-06"), True)).alias("before_last"))


@query("select p_partkey as id, case when p_size < 13 then 'small' else 'event' end as slug_base, case when p_size % 4 = 0 then null when p_size % 4 = 1 then 5 when p_size % 4 = 2 then -3 end as whole from part")
def loose_coercions(spark, sf_dir):
    k = F.col("p_size")
    text = F.when(k % 4 == 0, "5.5").when(k % 4 == 1, " 5 ").when(k % 4 == 2, "-3").otherwise("x")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), scalar.slugify(F.when(k < 13, " Small!_").otherwise("???")).alias("slug_base"), scalar.coerce_int(text).alias("whole"))


@query("select c_custkey as id, c_mktsegment as last_name, c_nationkey as first_name from customer order by c_mktsegment desc, c_nationkey desc, c_custkey limit 30 offset 60")
def page_by_names(spark, sf_dir):
    """The third page by last and first name, descending."""
    rows = view(spark, sf_dir, "customer", ["c_custkey as id", "c_mktsegment as last_name", "c_nationkey as first_name"])
    return reports.sorted_page(rows, "-name", {"name": ("last_name", "first_name")}, "id", 3, 30)


@query(f"with {R} select run_id from r order by started_at desc, run_id desc limit 25")
def latest_runs(spark, sf_dir):
    return reports.latest(view(spark, sf_dir, "orders", RUNS), "started_at", "run_id", 25).select("run_id")


# Suppliers are merged into the one before them, in blocks of seven, in an order that has nothing to do with their ids.
@query("""with s as (select s_suppkey as id, case when s_suppkey % 3 = 1 then concat('n', s_nationkey) end as phone, case when s_suppkey % 4 = 2 then s_name end as name, s_suppkey % 7 = 1 or s_suppkey % 5 = 0 as stays from supplier),
g as (select *, max(case when stays then id end) over (order by id rows between unbounded preceding and current row) as root from s)
select root as person_id, arg_min(phone, id) filter (phone is not null) as phone, arg_min(name, id) filter (name is not null) as name from g group by 1""")
def merges_undone_by_replay(spark, sf_dir):
    """A history of merges, one batch after the other, of which every fifth is undone."""
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(k.alias("person_id"), F.when(k % 3 == 1, F.concat(F.lit("n"), "s_nationkey")).alias("phone"), F.when(k % 4 == 2, F.col("s_name")).alias("name"))
    merges = own.filter("person_id % 7 <> 1 and person_id > 0").select((F.col("person_id") * 7919 % 1000003).alias("suggestion_id"), (F.col("person_id") - 1).alias("primary_id"), F.col("person_id").alias("candidate_id"))
    side = lambda name: own.select(F.col("person_id").alias(f"{name}_id"), F.struct("phone", "name").alias(f"{name}_before"))
    log = merges.join(side("primary"), "primary_id").join(side("candidate"), "candidate_id")
    people = merge.replay(own, merges, ["phone", "name"])
    return merge.undo_by_replay(people, log, merges.filter("candidate_id % 5 = 0"))[0]


@query("""with recursive l as (select c_custkey as id, case when c_custkey % 10 = 9 then c_custkey - (c_custkey // 10) % 9 else c_custkey + 1 end as to_id from customer where c_custkey % 10 <> 5),
w as (select id, id as at, 0 as n from l union all select w.id, l.to_id, n + 1 from w join l on l.id = w.at where n < 24),
e as (select id, max(case when l.id is null then w.at end) as stop, min(case when n >= 12 then w.at end) as least from w left join l on l.id = w.at group by w.id)
select id as candidate_id, coalesce(stop, least) as primary_id from e where id <> coalesce(stop, least)""".replace("select id, max(", "select w.id as id, max("))
def rings_of_merges(spark, sf_dir):
    """Chains that end, and chains that run into rings of up to nine; of a ring the least person stays."""
    k = F.col("c_custkey")
    to = F.when(k % 10 == 9, k - F.floor(k / 10) % 9).otherwise(k + 1)
    pairs = table(spark, sf_dir, "customer").filter(k % 10 != 5).select(k.alias("suggestion_id"), to.alias("primary_id"), k.alias("candidate_id"))
    return merge.resolved_pairs(pairs).select("candidate_id", "primary_id")
