"""Results at the edges of periods and blocks, and work that follows distinct values instead of pairs of rows."""

import datetime
import time

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from kinfold import queries
from kinfold.operators import alike, load, match
from kinfold.streaming import first_wins


def test_aging_goes_by_the_microsecond(spark, tmp_path):
    """Half a second less than a day or two is not a day or two."""
    at = datetime.datetime(2024, 1, 30)
    ages = [datetime.timedelta(hours=h, microseconds=-m) for h in (24, 48) for m in (-1, 0, 1, 500_000)]
    rows = spark.createDataFrame([(i, at - a) for i, a in enumerate(ages)] + [(99, None)], "event_id long, ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r["bucket"]: r["n"] for r in queries.queries()["aging_buckets"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(con.sql(queries.oracle_sql()["aging_buckets"]).fetchall()) == {"under_24h": 2, "24h_to_48h": 4, "over_48h": 3}


def against_sql(spark, name, tmp_path, **tables):
    """The rows of a query over small tables, sorted, after holding them against its SQL."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    frame = queries.queries()[name](spark, str(tmp_path))
    got = sorted((tuple(float(v) if c in ("score", "name_sim") else v for c, v in r.asDict().items()) for r in frame.collect()), key=str)
    made = con.sql(f"select {', '.join(frame.columns)} from ({queries.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(float(v) if c in ("score", "name_sim") else v for c, v in zip(frame.columns, r, strict=True)) for r in made), key=str)
    return got


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_the_banded_scan_takes_pairs_of_all_brands(spark, tmp_path, monkeypatch):
    """Equal, nearly equal and differently written names, over several chunks of a block; nothing hangs on the brand."""
    monkeypatch.setattr("kinfold.operators.match.in_chunks.__defaults__", (3,))
    names = ["cold ring", "old ring", "Cold ring", "new bolt", "newer bolt", "colds ring"]
    rows = [(i * 7 % 60, names[i % 6], f"b{i % 5}", None if i % 11 == 0 else f"t{i % 2}", i % 4, None if i % 13 == 0 else float(i % 3)) for i in range(60)]
    got = against_sql(spark, "duplicate_scan_banded", tmp_path, part=(rows, PART))
    brand, name = ({r[0]: r[k] for r in rows} for k in (2, 1))
    assert any(brand[a] != brand[b] for a, b, *_ in got) and any(name[a] != name[b] for a, b, *_ in got)


def sharing(spark, ident, n):
    """n rows with one address and one number."""
    return spark.range(n).select(F.col("id").alias(ident), F.lit("box1@org.test").alias("email"), F.lit("+14155550100").alias("phone"))


def test_a_shared_address_is_met_once(spark):
    """30,000 rows and 30,000 people of one address and number: not 900 million pairs. Rows of one id are taken together."""
    began = time.monotonic()
    got = match.match_by_contact(sharing(spark, "row_id", 30_000), sharing(spark, "person_id", 30_000), prefix=True)
    assert got.groupBy("outcome").count().collect() == [("ambiguous", 30_000)]
    assert time.monotonic() - began < 60
    schema = "long, email string, phone string"
    left = spark.createDataFrame([(1, "a@x.org", None), (1, None, "+14155550101"), (2, "a@x.org", "+14155550101"), (3, "b@x.org", None), (None, "b@x.org", None)], f"row_id {schema}")
    right = spark.createDataFrame([(7, "a@x.org", "+14155550101"), (7, "a@x.org", "+14155550101"), (8, "a@x.org", None), (9, "b+1@x.org", None)], f"person_id {schema}")
    got = match.match_by_contact(left, right, prefix=True).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "combined", 7), (1, "combined", 7), (2, "combined", 7), (3, "email", 9), (None, "none", None)]


FIELDS = "first_name string, last_name string, dob string, street string, city string, postal_code string, employer string, school string, emails array<string>, phones array<string>"


def alike_people(spark, ident, n, mail="a@x.org"):
    given = {"first_name": "Ann", "last_name": "Lee", "dob": "1990-01-01"}
    columns = [F.lit(given.get(f)).cast("string").alias(f) for f in ("first_name", "last_name", "dob", "street", "city", "postal_code", "employer", "school")]
    return spark.range(1, n + 1).select(F.col("id").alias(ident), *columns, F.array(F.lit(mail)).alias("emails"), F.lit(None).cast("array<string>").alias("phones"))


def test_people_of_the_same_values_are_compared_once(spark):
    """20,000 rows and 20,000 people alike in everything: 400 million pairs are counted, not formed."""
    none = spark.createDataFrame([], "row_id long, person_id long")
    rows = alike_people(spark, "row_id", 20_000).withColumn("matched", F.lit(False))
    began = time.monotonic()
    counts = match.generate_candidates(rows, alike_people(spark, "person_id", 20_000), none)[1].head().asDict()
    assert counts["review_pairs"] == counts["suggestions_created"] == 400_000_000 and counts["skipped_no_candidates"] == 0
    assert time.monotonic() - began < 90


def test_fallback_takes_people_not_profiles(spark):
    """Twelve people of one profile and one of another in the name block: the first ten by id, whatever their profile."""
    rows = alike_people(spark, "row_id", 2, "other@x.org").withColumn("matched", F.lit(False))
    people = alike_people(spark, "person_id", 13).withColumn("dob", F.when(F.col("person_id") == 4, "1990-06-01").otherwise(F.col("dob")))
    existing = spark.createDataFrame([(1, 1)], "row_id long, person_id long")
    new, counts = match.generate_candidates(rows, people, existing)
    assert counts.head()["low_pairs"] == 20 and new.count() == 0
    rows = rows.withColumn("emails", F.when(F.col("row_id") == 1, F.array(F.lit("a@x.org"))))
    new, counts = match.generate_candidates(rows, people, existing)
    assert {(r["row_id"], r["person_id"]) for r in new.collect()} == {(1, i) for i in range(2, 14) if i != 4} | ({(1, 4)} if 0.45 + 0.2 * (1 - 151 / 730) >= 0.6 else set())
    assert counts.head()["low_pairs"] == 10 and counts.head()["suggestions_created"] == 13


def test_a_scan_of_alike_people_scores_them_once(spark):
    """10,000 people alike in everything are 50 million pairs of one score."""
    began = time.monotonic()
    found = match.scan_duplicates(alike_people(spark, "person_id", 10_000), spark.createDataFrame([(2, 3)], "primary_id long, candidate_id long"))
    counts = found.groupBy("name", "score", F.expr("primary_id < candidate_id")).count().collect()
    assert [tuple(r) for r in counts] == [(1.0, 0.97, True, 10_000 * 9_999 // 2 - 1)]
    assert time.monotonic() - began < 90


def test_rows_meet_a_shared_key_once(spark):
    """30,000 rows and 30,000 people of one address and number: the counts say several, without 900 million pairs."""
    began = time.monotonic()
    keys = spark.range(30_000).select(F.col("id").alias("person_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("mail", "m"), ("phone", "p"))])).alias("k")).select("person_id", "k.*")
    probes = keys.withColumnRenamed("person_id", "clean_id").withColumn("as_kind", F.col("kind"))
    met = load._met(probes, keys).groupBy("n_mail", "n_phone", "n_both", "both_id", "contact_id", "mail_id").count().collect()
    assert [tuple(r) for r in met] == [(2, 2, 2, 0, 0, 0, 30_000)]
    assert time.monotonic() - began < 60


class Held:
    """A list state that counts its calls."""

    def __init__(self):
        self.rows, self.calls = [], 0

    def getListState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def registerTimer(self, at):
        self.calls += 1


def test_a_bucket_of_keys_costs_a_few_calls():
    """1,000 keys in two blocks and a later batch: three calls a batch, not three a key."""
    state = Held()
    wins = first_wins.FirstWins(["k", "seq"], ["k"], "seq")
    wins.init(state)
    block = lambda ids: pd.DataFrame({"k": [f"k{i % 1000}" for i in ids], "seq": list(ids)})
    for batch, firsts in (([range(1000, 2000), range(500, 1000), range(1999, 2500)], 1000), ([range(3000, 4000)], 0)):
        state.calls = 0
        out = pd.concat(wins.handleInputRows((0, 5, "", 0), map(block, batch), None))
        assert len(out) == sum(map(len, batch)) and (out.decision == "first").sum() == firsts and state.calls <= 3
        if firsts:
            assert set(out[out.decision == "first"].seq) == set(range(500, 1000)) | set(range(1000, 1500))


def test_names_under_low_limits_are_compared_in_arrays(spark):
    """12,000 names of one length in one block: 72 million pairs, which must not go through a join one by one."""
    names = spark.range(12_000).select(F.concat(F.lit("a"), F.left(F.md5(F.col("id").cast("string").cast("binary")), F.lit(9)), F.lit(" l")).alias("name"), F.lit("l").alias("last"))
    began = time.monotonic()
    got = alike.alike_names(names, 0.88).agg(F.count(F.lit(1)), F.min("similarity"), F.count_if(F.col("a") >= F.col("b"))).head()
    assert got[0] > 1_000 and got[1] >= 0.88 and got[2] == 0
    assert time.monotonic() - began < 45
