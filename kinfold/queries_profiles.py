"""Queries of mergeable field statistics and of payloads as VARIANT, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import payloads, profiles, sampling
from kinfold.operators.mapping import Spec
from kinfold.operators.materialize import cut, scratch_path
from kinfold.registry import query, table
from kinfold.sources.run_store import RunStore

NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
FIELDS = [*NUMBERS, "o_orderstatus", "o_orderpriority"]
FIRST, LAST = "1993-04", "1996-11"
PERIOD = f"orders where strftime(o_orderdate, '%Y-%m') between '{FIRST}' and '{LAST}'"


def by_month(spark, sf_dir) -> profiles.Profiles:
    """Two batches, each with rows of all months, and the second once more, which changes nothing."""
    rows = table(spark, sf_dir, "orders")
    kept = profiles.Profiles(RunStore(spark, scratch_path(spark, "profiles")), "orders")
    for batch in (0, 1, 1):
        kept.commit(batch, rows.filter(F.pmod("o_orderkey", F.lit(2)) == batch), FIELDS, F.date_format("o_orderdate", "yyyy-MM"))
    return kept


@query(" union all ".join(
    f"select '{f}' as field, count(*) as total, count(*) - count({f}) as nulls, min({f})::varchar as min_value, max({f})::varchar as max_value, {f'round(avg({f}), 4)' if f in NUMBERS else 'null::double'} as avg_value from {PERIOD}" for f in FIELDS if f != "o_totalprice"
))
def profile_statistics(spark, sf_dir):
    found = profiles.statistics(profiles.merged(by_month(spark, sf_dir).between(FIRST, LAST)))
    return found.filter("field <> 'o_totalprice'").select("field", "total", "nulls", "min_value", "max_value", "avg_value")


@query("""with v as (select strftime(o_orderdate, '%Y') as year, 'o_orderpriority' as field, o_orderpriority as value from orders union all select strftime(o_orderdate, '%Y'), 'o_orderstatus', o_orderstatus from orders),
n as (select year, field, value, count(*) as n from v where value is not null group by 1, 2, 3) select year, field, value, n, row_number() over (partition by year, field order by n desc, value) as place from n""")
def profile_frequent_values(spark, sf_dir):
    years = by_month(spark, sf_dir).between().withColumn("year", F.substring("part", 1, 4))
    found = profiles.statistics(profiles.merged(years, ("year",))).filter("field in ('o_orderpriority', 'o_orderstatus')")
    return found.select("year", "field", F.posexplode("frequent").alias("place", "v")).select("year", "field", "v.value", "v.n", (F.col("place") + 1).cast("long").alias("place"))


@query(" union all ".join(f"select '{f}' as field, true as distinct_close, {'true' if f in NUMBERS else 'null::boolean'} as quartiles_close" for f in FIELDS))
def profile_estimates_close(spark, sf_dir):
    """The estimates of the sketches against the exact values: distinct values within 3 %, ranks of quartiles within 1.65 %."""
    rows = table(spark, sf_dir, "orders")
    found = cut(profiles.statistics(profiles.merged(by_month(spark, sf_dir).between())).select("field", "distinct_estimate", "quantiles"), "estimates")
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in NUMBERS])).alias("r")).select("r.*").filter("x is not null")
    ranked = values.join(F.broadcast(found), "field").groupBy("field").agg(  # one row a field
        *[(F.greatest(F.avg((F.col("x") < F.col("quantiles")[i]).cast("int")) - r, r - F.avg((F.col("x") <= F.col("quantiles")[i]).cast("int")))).alias(f"e{i}") for i, r in enumerate((0.25, 0.5, 0.75))]
    ).select("field", F.greatest("e0", "e1", "e2").alias("error"))
    exact = sampling.field_statistics(rows, FIELDS).select("field", "distinct_values")
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_values")) <= 0.03 * F.col("distinct_values")
    return found.join(exact, "field").join(ranked, "field", "left").select("field", near.alias("distinct_close"), (F.col("error") <= 0.0165).alias("quartiles_close"))


ORDER = Spec.of("order", [
    {"target": "id", "source": "Id", "required": True}, {"target": "status", "source": "Status", "default": "?"}, {"target": "account.id", "source": "Account.Id"},
    {"target": "account.tier", "source": "Account.Tier.Level"}, {"target": "first_part", "source": "Items[0].Part"},
])
PART = Spec.of("part of an order", [{"target": "id", "source": "Id"}, {"target": "account", "source": "Account.Id"}])


def order_payloads(spark, sf_dir):
    """(o_orderkey, payload): orders as a CRM would send them, with accounts and items inside; every 11th is cut off."""
    item = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "back").alias("flag"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = table(spark, sf_dir, "orders").join(items, "o_orderkey", "left")
    tier = F.struct(F.when(F.col("o_custkey") % 3 == 0, "gold").alias("Level"), F.lit("x").alias("since.year"), F.lit("").alias("blank"))
    body = F.to_json(F.struct(
        F.col("o_orderkey").alias("Id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("Status"), F.struct(F.col("o_custkey").alias("Id"), tier.alias("Tier")).alias("Account"),
        F.when(F.col("o_orderkey") % 5 == 0, "  ").otherwise(F.col("o_orderpriority")).alias("Notes"), F.transform("items", lambda i: F.struct(i["l_partkey"].alias("Part"), i["flag"].alias("Flag"))).alias("Items"),
    ))
    return payloads.parsed(rows.select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body")), "body")


WHOLE = "o as (select * from orders where o_orderkey % 11 <> 0), i as (select * from lineitem where l_orderkey in (select o_orderkey from o))"


@query(f"""with {WHOLE}, f as (select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) as part from i group by 1)
select o_orderkey, o_orderkey % 11 = 0 as broken, case when o_orderkey % 11 <> 0 then o_orderkey::varchar end as id, case when o_orderkey % 11 <> 0 and o_orderkey % 4 <> 0 then coalesce(o_orderstatus, '?') else '?' end as status,
  case when o_orderkey % 11 <> 0 then o_custkey::varchar end as account, case when o_orderkey % 11 <> 0 and o_custkey % 3 = 0 then 'gold' end as tier, part::varchar as first_part, (o_orderkey % 11 = 0)::int::bigint as n_errors
from orders left join f on l_orderkey = o_orderkey""")
def payload_mapping(spark, sf_dir):
    mapped = payloads.map_payload(order_payloads(spark, sf_dir), "payload", ORDER, ("o_orderkey", "broken"))
    return mapped.select("o_orderkey", "broken", "id", "status", F.col("account.id").alias("account"), F.col("account.tier").alias("tier"), "first_part", F.size("errors").cast("long").alias("n_errors"))


@query(f"""with {WHOLE}, p as (
  select 'Status' as path, o_orderkey as k from o where o_orderkey % 4 <> 0 and o_orderstatus is not null union all select 'Account.Tier.Level', o_orderkey from o where o_custkey % 3 = 0
  union all select 'Account.Tier[''since.year'']', o_orderkey from o union all select 'Notes', o_orderkey from o where o_orderkey % 5 <> 0 and o_orderpriority is not null
  union all select 'Items[].Part', l_orderkey from i where l_partkey is not null union all select 'Items[].Flag', l_orderkey from i where l_returnflag = 'R')
select path, count(distinct k) as records, count(*) as occurrences from p group by 1""")
def payload_unmapped_paths(spark, sf_dir):
    found = payloads.unmapped(order_payloads(spark, sf_dir), "o_orderkey", "payload", PART)
    return payloads.path_counts(found, "o_orderkey")
