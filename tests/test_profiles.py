"""Mergeable statistics against exact ones, and payloads against a walk in Python."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.operators import mapping, payloads, profiles, sampling
from kinfold.sources.run_store import RunStore

FIELDS = ["n", "x", "t.u", "d"]


def rows(spark, n=3000, parts=7):
    rng = random.Random(5)
    made = [(i % parts if i % 10 else None, rng.choice([None, rng.randrange(-50, 900)]), rng.choice([None, rng.uniform(-3, 3)]), rng.choice([None, "", "a", f"w{rng.randrange(400)}"]), None) for i in range(n)]
    return spark.createDataFrame(made, "part long, n int, x double, `t.u` string, d date")


def by_field(frame):
    return {r["field"]: r for r in frame.collect()}


def test_any_split_merges_to_the_exact_statistics(spark, tmp_path):
    all_rows = rows(spark)
    exact = by_field(sampling.field_statistics(all_rows.withColumnRenamed("t.u", "tu"), ["n", "x", "tu", "d"]))
    kept = profiles.Profiles(RunStore(spark, str(tmp_path / "s")), "p")
    for batch in (0, 1, 1, 2):
        kept.commit(batch, all_rows.filter(F.pmod(F.xxhash64("n", "x"), F.lit(3)) == batch), FIELDS, F.col("part"))
    for parts in (kept.between(), profiles.profile(all_rows, FIELDS, F.lit("whole")), profiles.merged(kept.between(), ("part",))):
        got = by_field(profiles.statistics(profiles.merged(parts)))
        for f in FIELDS:
            e, g = exact[f.replace(".", "")], got[f]
            assert (g["total"], g["nulls"]) == (e["total"], e["nulls"])
            assert abs(g["distinct_estimate"] - e["distinct_values"]) <= 0.03 * e["distinct_values"]
            assert (g["min_value"], g["max_value"]) == (e["min_value"], e["max_value"])
            assert g["avg_value"] == (pytest.approx(e["avg_value"], abs=2e-4) if e["avg_value"] is not None else None)
        for f in ("n", "x"):
            values = sorted(r[0] for r in all_rows.filter(f"{f} is not null").select(f).collect())
            for rank, q in zip((0.25, 0.5, 0.75), got[f]["quantiles"]):
                low, high = sum(v < q for v in values) / len(values), sum(v <= q for v in values) / len(values)
                assert low - 0.0165 <= rank <= high + 0.0165
        assert got["t.u"]["quantiles"] is None and got["d"]["quantiles"] is None and got["d"]["frequent"] == []
        want = Counter(r[0] for r in all_rows.select("`t.u`").collect() if r[0] is not None)
        assert [tuple(v) for v in got["t.u"]["frequent"]][:2] == sorted(want.items(), key=lambda v: (-v[1], v[0]))[:2]
    period = by_field(profiles.statistics(profiles.merged(kept.between("2", "4"))))
    assert period["n"]["total"] == all_rows.filter("part between 2 and 4").count()


def test_empty_tables_and_parts(spark, tmp_path):
    none = rows(spark).limit(0)
    assert profiles.profile(none, FIELDS, F.col("part")).count() == 0
    assert profiles.statistics(profiles.merged(profiles.profile(none, FIELDS, F.col("part")))).count() == 0
    kept = profiles.Profiles(RunStore(spark, str(tmp_path / "s")), "p")
    kept.commit(0, none, FIELDS, F.col("part"))
    kept.commit(1, rows(spark, 40), FIELDS, F.col("part"))
    assert by_field(profiles.statistics(profiles.merged(kept.between())))["n"]["total"] == 40


def test_a_profile_is_one_pass_that_adds_up_first(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows(spark).withColumnRenamed("t.u", "t").withColumn("other", F.lit("long")).write.parquet(path)
    plan = profiles.profile(spark.read.parquet(path), ["n", "t"], F.col("part"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan and "other" not in plan and "partial_hll" in plan


def walk(node, path=""):
    """(path, text) of the values that are given."""
    if isinstance(node, dict):
        for k, v in node.items():
            odd = k == "" or any(c in k for c in ".[]'\"")
            yield from walk(v, f"{path}['{k}']" if odd else f"{path}.{k}" if path else k)
    elif isinstance(node, list):
        for v in node:
            yield from walk(v, path + "[]")
    elif node is not None and str(node).strip():
        yield path, node


def grown(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.4:
        return rng.choice([None, "", "  ", "a", 7, "ü"])
    if kind < 0.6:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "c.d", "e f", "", "g[0]"]): grown(rng, depth - 1) for _ in range(rng.randrange(4))}


def payload_rows(spark, texts):
    return payloads.parsed(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text")


def test_leaves_equal_a_walk(spark):
    rng = random.Random(11)
    bodies = [{k: grown(rng, 4) for k in ("a", "b", "x")} for _ in range(60)] + [[{"a": 1}, [2, [3]]], {}, [], 5]
    frame = payload_rows(spark, [json.dumps(b) for b in bodies] + ["{cut", "", None])
    want = [(i, p, v) for i, b in enumerate(bodies) if isinstance(b, (dict, list)) for p, v in walk(b)]
    found = payloads.leaves(frame, "id", "payload")
    assert Counter((r["id"], r["path"]) for r in found.collect()) == Counter((i, p) for i, p, _ in want)
    assert Counter(r["value"] for r in found.collect()) == Counter(str(v).strip() for *_, v in want)
    counts = {r["path"]: (r["records"], r["occurrences"]) for r in payloads.path_counts(found, "id").collect()}
    assert counts == {p: (len({i for i, q, _ in want if q == p}), n) for p, n in Counter(p for _, p, _ in want).items()}
    assert [r["id"] for r in frame.filter("broken").collect()] == [len(bodies)]


def test_what_is_read_goes_with_all_under_it(spark):
    frame = payload_rows(spark, ['{"a": {"b": 1, "c": {"d": 2}}, "ab": 3, "l": [{"p": 4, "q": 5}]}'])
    spec = mapping.Spec.of("s", [{"target": "x", "source": "a.c"}, {"target": "y", "source": "l[0].p"}])
    assert sorted(r["path"] for r in payloads.unmapped(frame, "id", "payload", spec).collect()) == ["a.b", "ab", "l[].q"]


def test_map_payload(spark):
    spec = mapping.Spec.of("s", [
        {"target": "name", "source": "who.name", "required": True}, {"target": "odd", "source": "['c.d'].e"}, {"target": "kind", "source": "kind", "default": "none"}, {"target": "whole", "source": "who"},
    ])
    frame = payload_rows(spark, ['{"who": {"name": " Ann "}, "c.d": {"e": 3}}', '{"who": 5, "kind": ""}', None, "[1]"])
    got = payloads.map_payload(frame, "payload", spec, ("id",)).orderBy("id").collect()
    assert [(r["name"], r["odd"], r["kind"], r["whole"]) for r in got] == [("Ann", "3", "none", '{"name":" Ann "}'), (None, None, "none", "5"), (None, None, "none", None), (None, None, "none", None)]
    assert [r["errors"] for r in got] == [[], *[["Missing required field: who.name"]] * 3]


def test_no_payloads(spark):
    empty = payload_rows(spark, ["{}"]).limit(0)
    assert payloads.leaves(empty, "id", "payload").count() == 0 and payloads.path_counts(payloads.leaves(empty, "id", "payload"), "id").count() == 0
