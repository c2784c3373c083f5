"""Completeness by deltas against recounts, with replays, failures and what a commit reads."""

import random

import pytest

from kinfold.operators import completeness, population
from kinfold.sources.run_store import RunStore

SCHEMA = "id long, name string, hours long, meta map<string,string>"
FIELDS = ["name", "hours"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def recount(frame):
    return sorted(map(tuple, completeness.field_completeness(frame, FIELDS, zero=True).select("field", "total", "populated", "percent").collect()))


def kept(store, entity="p"):
    got = population.Population(store).completeness().filter(f"entity = '{entity}'")
    return sorted(map(tuple, got.select("field", "total", "populated", "percent").collect()))


def test_mixed_changes_equal_a_recount(spark, tmp_path):
    rng, store = random.Random(3), RunStore(spark, str(tmp_path / "s"))
    keeper, now = population.Population(store), {}

    def row(i):
        return (i, rng.choice([None, "", "x"]), rng.choice([None, 0, 5]), rng.choice([None, {}, {"a": "1"}, {"a": "", "b": "2", "payload_hash": "z"}]))

    assert keeper.completeness().count() == 0
    for batch in range(3):
        old, new = [], []
        for i in range(batch * 20, batch * 20 + 30):
            if i in now:
                old.append(now.pop(i))
            if rng.random() < 0.7:
                now[i] = row(i)
                new.append(now[i])
        log = population.changes(frame(spark, old), frame(spark, new))
        keeper.commit(batch, {"p": (log, FIELDS)}, {"p": (log, "meta")}, zero=True)
        whole = frame(spark, list(now.values()))
        assert kept(store) == recount(whole)
        want = {r["key"]: r["populated"] for r in completeness.metadata_completeness(whole, "meta", []).collect()}
        assert {r["key"]: r["populated"] for r in keeper.keys().collect()} == want
    before = kept(store)
    keeper.commit(2, {"p": (log, FIELDS)}, zero=True)  # sent again
    assert kept(store) == before and store.versions() == [1, 2, 3]
    everything = population.changes(whole, frame(spark, []))
    keeper.commit(3, {"p": (everything, FIELDS)}, {"p": (everything, "meta")}, zero=True)
    assert kept(store) == [("hours", 0, 0, 0.0), ("name", 0, 0, 0.0)] and keeper.keys().count() == 0
    assert keeper.completeness(1).filter("total > 0").count() == 2  # an earlier version


def test_a_failed_commit_adds_nothing(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "s"))
    rows = frame(spark, [(1, "x", 1, None), (2, None, None, None)])
    population.Population(store).commit(0, {"p": (population.changes(rows.limit(0), rows), FIELDS)})
    before = kept(store)
    with monkeypatch.context() as m:
        m.setattr(RunStore, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            population.Population(store).commit(1, {"p": (population.changes(rows.limit(0), rows), FIELDS)})
    assert kept(store) == before
    population.Population(store).commit(1, {"p": (population.changes(rows.limit(0), rows), FIELDS), "q": (population.changes(rows.limit(0), rows.limit(1)), FIELDS)})
    assert [r[1] for r in kept(store)] == [4, 4] and [r[1] for r in kept(store, "q")] == [1, 1]


def test_a_delta_reads_its_log_once_and_only_the_fields(spark, tmp_path):
    path = str(tmp_path / "log")
    frame(spark, [(1, "x", 1, None)]).selectExpr("*", "1 as sign", "'long' as other").write.parquet(path)
    plan = population.field_delta(spark.read.parquet(path), "p", FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "other" not in plan and "Expand" not in plan and "partial_sum" in plan


def test_null_signs_and_empty_logs(spark):
    rows = frame(spark, [(1, "x", 1, {"a": "1"})]).selectExpr("*", "cast(null as int) as sign")
    assert [tuple(r) for r in population.field_delta(rows, "p", FIELDS).collect()] == [("p", "name", 0, 0), ("p", "hours", 0, 0)]
    assert [tuple(r) for r in population.field_delta(rows.limit(0), "p", FIELDS).collect()] == [("p", "name", 0, 0), ("p", "hours", 0, 0)]
    assert population.key_delta(rows.limit(0), "p", "meta").count() == 0


def test_samples_of_parts_merge(spark):
    from kinfold.operators import sampling

    rows = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 'high' else 'low' end as level", "id % 4 as part")
    quotas = {"high": 7, "low": 3, "none": 2}
    whole = sampling.stratified(rows, "level", quotas, "id", 5)
    parts = None
    for p in range(4):
        one = sampling.stratified(rows.filter(f"part = {p}"), "level", quotas, "id", 5)
        parts = one if parts is None else parts.unionByName(one)
    assert sorted(whole.collect()) == sorted(sampling.stratified(parts, "level", quotas, "id", 5).collect())
    assert sorted(r["level"] for r in whole.collect()) == ["high"] * 7 + ["low"] * 3
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sampling.stratified(rows.limit(0), "level", quotas, "id").count() == 0 == sampling.stratified(rows, "level", {}, "id").count()
