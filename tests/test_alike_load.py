"""The similarity join of names, connected components, and the ordered load of chains and stars."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.functions.similarity import jaro_winkler_text
from kinfold.operators import alike, load
from kinfold.operators.components import components
from tests.test_people import plain_loads

ROW = "clean_id long, external_system string, external_id string, mail string, phone string, name string"
CORE = "person_id long, mail string, phone string, name string"
MAP = "external_system string, external_id string, entity_id long, is_active boolean"


def invented(rng, initial="a"):
    return initial + "".join(rng.choice(["an", "el", "ri", "ton", "sha", "mi", "o", "u", "ber", "t", "kie", "lyn", "z"]) for _ in range(rng.randrange(1, 5)))


@pytest.mark.parametrize(("least", "part"), [(0.95, 2000), (0.9, 7), (0.8, 2000), (0.6, 50)])
def test_alike_names_equal_brute_force(spark, least, part):
    rng = random.Random(4)
    rows = [(f"{invented(rng, rng.choice('ab'))} {last}", last) for last in ("bell", "o", "van der berg") for _ in range(90)]
    rows += [("anna", "bell"), ("a", "bell"), ("ab lee", "bell"), ("", "bell"), (None, "bell"), ("anna bell", None), ("Ünal bell", "bell"), ("Ünals bell", "bell"), ("anna-maria josepha bell", "bell"), ("anna-maria josephina bell", "bell")]
    rows += rows[:20]
    got = alike.alike_names(spark.createDataFrame(rows, "name string, last string"), least, part).collect()
    names = sorted({r for r in rows if r[0] and r[1]})
    want = {(a, b, la) for a, la in names for b, lb in names if a < b and la == lb and a[0] == b[0] and jaro_winkler_text(a, b) >= least}
    assert Counter((r["a"], r["b"], r["last"]) for r in got) == Counter(want)


def test_few_pairs_of_a_large_block_are_compared(spark):
    rng = random.Random(1)
    names = {invented(rng) + invented(rng, "") for _ in range(15_000)}
    rows = spark.createDataFrame([(f"{n} smith", "smith") for n in sorted(names)[:5_000]], "name string, last string")
    n = rows.count()
    assert n == 5_000
    compared = alike.name_candidates(rows, load.NEAR_NAME).count()
    assert compared < 0.02 * n * (n - 1) / 2


def test_only_wanted_names_are_paired(spark):
    rows = [("anna bell", "bell", False), ("annas bell", "bell", False), ("annab bell", "bell", True)]
    got = alike.alike_names(spark.createDataFrame(rows, "name string, last string, wanted boolean"), 0.9).collect()
    assert {(r["a"], r["b"]) for r in got} == {("anna bell", "annab bell"), ("annab bell", "annas bell")}


def test_components(spark):
    rng = random.Random(2)
    ids = list(range(0, 3000, 3))
    rng.shuffle(ids)
    links = list(zip(ids[:400], ids[1:400], strict=False)) + [(ids[500], x) for x in ids[501:700]] + [(ids[800], ids[800]), (None, 5), (7, None)]
    links += [(ids[900], ids[901]), (ids[901], ids[902]), (ids[902], ids[900])]
    frame = spark.createDataFrame(links + links[:50], "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    want = {x: min(g) for g in (ids[:400], ids[500:700], ids[800:801], ids[900:903]) for x in g}
    assert got == want
    assert components(frame.limit(0)).count() == 0


def loads(spark, rows, core=(), **how):
    clean = spark.createDataFrame(rows, ROW)
    spark.sparkContext.setJobGroup("loads", "loads")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("loads"))
    got = load.decide_loads(clean, spark.createDataFrame(list(core), CORE), spark.createDataFrame([], MAP), **how)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("loads")) - before
    spark.sparkContext.setJobGroup("tests", "tests")
    return {r["clean_id"]: (r["load_action"], r["entity_id"]) for r in got.collect()}, jobs


def plain(rows, core=()):
    return plain_loads([dict(zip(("clean_id", "external_system", "external_id", "mail", "phone", "name"), r, strict=True)) for r in rows], [dict(zip(("person_id", "mail", "phone", "name"), c, strict=True)) for c in core], [])


def test_a_chain_of_2000_keys_takes_a_bounded_number_of_jobs(spark):
    """Each row shares an address with the row before and a number with the one after."""
    chain = [(i, "s", f"x{i}", f"m{(i + 1) // 2}", f"p{i // 2}", None) for i in range(1, 2001)]
    got, jobs = loads(spark, chain)
    assert got == plain(chain)
    assert jobs < 400


def test_a_star_takes_two_rounds(spark):
    rows = spark.range(1, 100_001).select(F.col("id").alias("clean_id"), F.lit("s").alias("external_system"), F.concat(F.lit("x"), "id").alias("external_id"), F.lit("one@x.org").alias("mail"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("name"))
    got = load.decide_loads(rows, spark.createDataFrame([], CORE), spark.createDataFrame([], MAP))
    counts = {r["load_action"]: (r["n"], r["e"]) for r in got.groupBy("load_action").agg(F.count(F.lit(1)).alias("n"), F.max("entity_id").alias("e")).collect()}
    assert counts == {"inserted": (1, 1), "deterministic_update": (99_999, 1)}


@pytest.mark.parametrize(("seed", "how"), [(0, {"rounds": 0}), (1, {"rounds": 0}), (2, {"rounds": 1, "largest": 3})])
def test_components_decide_as_rows_in_order(spark, seed, how):
    """Few keys, so rows hang together in many ways: numbers of several people, addresses added to known names, near names."""
    rng = random.Random(seed)
    pick = lambda kind, n: rng.choice([None, *[f"{kind}{i}" for i in range(n)]])
    named = lambda: rng.choice([None, *[f"{f} {last}" for f in ("christopher", "christophe", "christoph", "anna", "annabel") for last in ("bell", "gray")]])
    rows = [(i, "s", f"x{i}", pick("m", 14), pick("p", 8), named()) for i in range(1, 90)]
    core = [(i, pick("m", 5), pick("p", 3), named()) for i in range(1, 7)]
    last = F.element_at(F.split("name", " "), -1).alias("last")
    got = load.decide_loads(spark.createDataFrame(rows, ROW).select("*", last), spark.createDataFrame(core, CORE).select("*", last), spark.createDataFrame([], MAP), **how).collect()
    assert {r["clean_id"]: (r["load_action"], r["entity_id"]) for r in got} == plain(rows, core)
