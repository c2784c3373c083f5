"""Queries of what is kept up batch by batch: first-wins decisions and completeness by deltas; with SQL over the final tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import completeness, population
from kinfold.operators.materialize import scratch_path
from kinfold.registry import query, table
from kinfold.sources.run_store import RunStore
from kinfold.streaming import first_wins

OPEN = "select event_id, user_id, event_type, date_trunc('day', ts) as day, case when user_id is null or event_type is null then 'unkeyed' when ts is null then 'undated' end as known from events"
FIRST_WINS = f"""
with o as ({OPEN})
select event_id, cast(user_id as varchar) as user_id, event_type, strftime(day, '%Y-%m-%d') as day,
  coalesce(known, case when event_id = min(event_id) over (partition by user_id, event_type, day) then 'first' else 'duplicate' end) as decision from o"""
FIRST_KEYS = ["user_id", "event_type"]


def by_day(events):
    return events.select(*FIRST_KEYS, "event_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))


def shown(decided):
    return decided.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(FIRST_WINS)
def first_wins_by_day(spark, sf_dir):
    return shown(first_wins.decide(by_day(table(spark, sf_dir, "events")), FIRST_KEYS, "event_id", "day"))


@query(FIRST_WINS)
def first_wins_streamed(spark, sf_dir):
    """The same decisions by keyed state, over the table as a stream of files."""
    first_wins.keep_state(spark)
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes no single file
    made, out = first_wins.decide_stream(by_day(rows), FIRST_KEYS, "event_id", "day", "2 days"), scratch_path(spark, "first-wins")
    run = made.writeStream.outputMode("append").option("checkpointLocation", scratch_path(spark, "first-wins-state")).format("parquet").trigger(availableNow=True).start(out)
    run.awaitTermination()
    return shown(spark.read.schema(made.schema).parquet(out))


#: The history of each table: every row is inserted, some are revised (a field emptied, one filled), others deleted.
REVISED = {
    "documents": ("doc_id", ["lang", "source", "text", "n_chars"], {"lang": "case when n_chars % 2 = 0 then null else lang end", "source": "coalesce(source, 'filled')"}),
    "customer": ("c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], {"c_mktsegment": "case when c_nationkey % 4 = 0 then '' else c_mktsegment end", "c_nationkey": "case when c_nationkey = 3 then 0 else c_nationkey end"}),
}


def final_sql(name: str) -> str:
    """The table after the history: rows of every third key revised, then rows of every fifth key deleted."""
    key, fields, new = REVISED[name]
    shown = ", ".join(f"case when {key} % 3 = 0 then {new[f]} else {f} end as {f}" if f in new else f for f in fields)
    return f"select {shown} from {name} where {key} % 5 <> 0 or {key} is null"


def given_sql(name: str, field: str) -> str:
    """Whether a field is given: texts not empty, numbers not zero."""
    number = field in ("n_chars", "c_nationkey", "c_acctbal")
    return f"count(*) filter (where {field} is not null and {field} <> {0 if number else chr(39) * 2})"


DELTAS_SQL = " union all ".join(
    f"select '{n}' as entity, '{f}' as field, count(*) as total, {given_sql(n, f)} as populated from ({final_sql(n)}) t" for n, (_, fields, _) in REVISED.items() for f in fields
)


def counted_by_deltas(spark, sf_dir) -> population.Population:
    """Four commits: all rows inserted, the log of the revisions, that log once more (no effect), the log of the deletions."""
    kept = population.Population(RunStore(spark, scratch_path(spark, "population")))
    inserted, revised, deleted = {}, {}, {}
    for name, (key, fields, new) in REVISED.items():
        rows = table(spark, sf_dir, name)
        inserted[name] = (rows.withColumn("sign", F.lit(1)), fields)
        old = rows.filter(f"{key} % 3 = 0")
        now = old.select(*[F.expr(new[f]).alias(f) if f in new else f for f in rows.columns])
        revised[name] = (population.changes(old, now), fields)
        gone = rows.filter(f"{key} % 5 = 0 and {key} % 3 <> 0").unionByName(now.filter(f"{key} % 5 = 0"))
        deleted[name] = (gone.withColumn("sign", F.lit(-1)), fields)
    for batch, logs in ((0, inserted), (1, revised), (1, revised), (2, deleted)):
        kept.commit(batch, logs, zero=True)
    return kept


@query(f"with c as ({DELTAS_SQL}) select entity, field, total, populated, case when total = 0 then 0.0 else round(100.0 * populated / total, 2) end as percent from c")
def completeness_by_deltas(spark, sf_dir):
    return counted_by_deltas(spark, sf_dir).completeness()


@query(f"with c as ({DELTAS_SQL}) select entity, max(total) as total, round(avg(case when total = 0 then 0.0 else round(100.0 * populated / total, 2) end), 2) as completeness from c group by entity")
def entity_completeness_by_deltas(spark, sf_dir):
    return completeness.entity_completeness(counted_by_deltas(spark, sf_dir).completeness())
