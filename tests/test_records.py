"""Composed payloads, the clean layer, sample reports, stored contacts and values written back, on small cases."""

import datetime
import itertools

from pyspark.sql import functions as F

from kinfold.operators import clean, crm_load, merge, reports, sampling

ROWS = "row_id int, raw map<string,string>, normalized map<string,string>, status string, external_system string, external_id string"


def staged(spark, payloads, status="validated"):
    return spark.createDataFrame([(i, raw, own, status, "crm", f"X{i}") for i, (raw, own) in enumerate(payloads)], ROWS)


def plain_email(raw, own):
    """The e-mail part of a volunteer's payload, step by step."""
    raw, own = raw or {}, own or {}
    value = (raw.get("Email") or "").strip()
    out = {**raw, **({"email": value, "email_normalized": value} if value else {}), **own}
    nested = (out.get("email") or "").startswith("{")
    if value and not out.get("email"):
        out |= {"email": value, "email_normalized": value}
    elif not value and not nested:
        key = next((k for k in ("email_normalized", "VOL_EMAIL") if k in own), None)
        found = (own.get(key) or "").strip()
        if found:
            out |= {"email": found, "email_normalized": found} if key == "email_normalized" else {"email": found}
    return out


def test_composed_equals_a_plain_version(spark):
    absent = object()
    kinds = {"Email": (absent, None, "", " ", " a@x "), "email": (absent, None, "", "o@x", '{"home": 1}'), "email_normalized": (absent, " ", " n@x "), "VOL_EMAIL": (absent, "v@x")}
    cases = [dict(zip(kinds, c)) for c in itertools.product(*kinds.values())]
    payloads = [({k: v for k, v in c.items() if k == "Email" and v is not absent}, {k: v for k, v in c.items() if k != "Email" and v is not absent}) for c in cases]
    payloads += [(None, None), ({}, None), (None, {"email": "z"})]
    got = {r["row_id"]: r["payload"] for r in clean.composed(staged(spark, payloads), "volunteer").collect()}
    assert got == {i: plain_email(*p) for i, p in enumerate(payloads)}


def test_phones_and_other_entities(spark):
    rows = staged(spark, [({"Phone": "", "MobilePhone": " 2 ", "HomePhone": "3"}, {}), ({"Phone": " ", "MobilePhone": "2"}, {"VOL_PHONE": "9"}), ({"Phone": "1"}, {"phone": None})])
    got = [r["payload"] for r in clean.composed(rows, "volunteer").orderBy("row_id").collect()]
    assert [(p.get("phone"), p.get("phone_e164")) for p in got] == [("2", None), ("9", None), ("1", "1")]
    names = staged(spark, [({"Name": " A "}, {}), ({"Name": "A"}, {"name": ""}), ({"Name": "A"}, {"name": "B"}), ({}, None)])
    assert [r["payload"].get("name") for r in clean.composed(names, "organization").orderBy("row_id").collect()] == ["A", "A", "B", None]
    assert [r["payload"] for r in clean.composed(names, "event").orderBy("row_id").collect()] == [{"Name": " A "}, {"Name": "A", "name": ""}, {"Name": "A", "name": "B"}, {}]


def test_clean_layer(spark):
    rows = staged(spark, [({"Name": " A "}, {"external_id": "E"}), ({"Name": "A"}, {"name": " "}), ({"Name": ""}, None), ({"Name": "old"}, {}), (None, {"name": "N", "k": "v"})])
    made = clean.clean_entities(rows, "organization", rows.filter("row_id = 3"), "row_id")
    got = sorted((r["row_id"], r["external_id"], r["name"], tuple(sorted(r["payload"].items()))) for r in made.collect())
    assert got == [(0, "E", "A", (("external_id", "E"), ("name", "A"))), (4, "X4", "N", (("k", "v"), ("name", "N")))]
    assert tuple(clean.promotion_counts(rows, made).head()) == (5, 2, 3)
    bad = staged(spark, [({"Name": "A"}, {})], "quarantined")
    assert clean.clean_entities(bad, "event", bad.limit(0), "row_id").count() == 0
    links = staged(spark, [({"npe5__Contact__c": "C", "npe5__Organization__c": "O"}, {}), ({"npe5__Contact__c": "C"}, {})])
    assert [tuple(r)[3:5] for r in clean.clean_entities(links, "affiliation", links.limit(0), "row_id").collect()] == [("C", "O")]


def test_sample_report(spark):
    frame = spark.range(400).selectExpr("id", "case when id % 50 = 0 then 'high' when id % 2 = 0 then 'medium' else 'low' end as level", "case when id % 9 = 0 then array('odd') else array() end as reasons")
    got = sampling.sample_report(frame, "id", 50, 2).collect()
    levels = [r["level"] for r in got if not r["is_edge"]]
    assert len({r["id"] for r in got}) == len(got) == 50 and sum(r["level"] == "high" for r in got) == 8
    assert levels and all(r["is_edge"] == (r["id"] % 9 == 0) for r in got)
    assert [r["id"] for r in sampling.sample_report(frame.repartition(7), "id", 50, 2).orderBy("id").collect()] == sorted(r["id"] for r in got)
    assert sampling.sample_report(frame.limit(0), "id", 50).count() == 0 and sampling.sample_report(frame.filter("id < 4"), "id", 10).count() == 4
    full = sampling.sample_report(frame.withColumn("level", F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("id") % 3 + 1).cast("int"))), "id", 20)
    assert sorted(r["n"] for r in full.groupBy("level").agg(F.count("*").alias("n")).collect()) == [6, 6, 8]  # no room for edge cases


def test_stored_contacts(spark):
    columns = ["first_name", "last_name", "middle_name", "preferred_name", "type", "title", "internal_notes", "do_not_call", "do_not_email", "do_not_contact", "birthdate", "gender", "race", "education", "first_volunteer_date", "last_volunteer_date", "department", "description", "skills_text"]
    schema = "seq long, load_action string, entity_id long, " + ", ".join(f"{c} string" for c in columns)

    def record(seq, action, entity, **given):
        return (seq, action, entity, *[given.get(c) for c in columns])

    decided = spark.createDataFrame([
        record(1, "updated", 7, first_name="A", title="T1", gender="MALE", department="D", do_not_call="yes"), record(2, "no_change", 7, first_name="B", title=" ", birthdate="2001-02-03T10:00"),
        record(3, "inserted", None, first_name="C", skills_text="s"), record(4, "deleted", 8), record(5, "skipped_duplicate", 8, first_name="Z"),
    ], schema)
    fields = "entity_id long, source string, first_name string, last_name string, middle_name string, preferred_name string, type string, title string, internal_notes string, do_not_call boolean, do_not_email boolean, do_not_contact boolean, birthdate date, gender string, race string, education_level string, first_volunteer_date date, last_volunteer_date date, notes string"
    core = spark.createDataFrame([(7, "csv", "Old", "Name", "M", None, None, "T0", None, True, True, True, None, None, None, None, None, None, "n"), (8, "csv", "Eve", *[None] * 16)], fields)
    got = {r["entity_id"]: r for r in crm_load.stored_contacts(core, decided, ("male",), (), ()).collect()}
    assert sorted(got) == [7, 8, 11] and got[8]["first_name"] == "Eve" and got[8]["source"] == "csv"
    seven = got[7]
    assert (seven["first_name"], seven["last_name"], seven["middle_name"], seven["title"], seven["gender"], seven["notes"]) == ("B", None, "M", "T1", "male", "Department: D")
    assert (seven["do_not_call"], seven["do_not_email"], seven["birthdate"]) == (False, False, datetime.date(2001, 2, 3))
    assert (got[11]["first_name"], got[11]["notes"], got[11]["source"]) == ("C", "Skills: s", "salesforce")
    assert crm_load.stored_contacts(core.limit(0), decided.limit(0), (), (), ()).count() == 0


def test_written_back_and_aging(spark):
    people = spark.createDataFrame([(1, 5.0, None), (2, None, datetime.date(2010, 1, 31)), (3, 1.0, datetime.date(1959, 1, 30))], "person_id int, total_hours double, birth date")
    hours = spark.createDataFrame([(1, 2.5), (1, None), (1, 1.0), (9, 4.0), (3, None)], "person_id int, hours double")
    assert {r["person_id"]: r["total_hours"] for r in reports.total_hours(people, hours, "person_id").collect()} == {1: 3.5, 2: 0.0, 3: 0.0}
    assert {r["person_id"]: r["age_group"] for r in reports.age_groups(people, "birth", F.to_date(F.lit("2024-01-30"))).collect()} == {1: None, 2: "teen", 3: "senior"}
    at = F.to_timestamp(F.lit("2024-01-30 00:00:00"))
    runs = spark.createDataFrame([(1, 0), (2, 24), (3, 48), (4, None)], "run_id int, h int").select("run_id", F.when(F.col("h").isNotNull(), at - F.make_dt_interval(F.lit(0), "h")).alias("created_at"))
    waiting = spark.createDataFrame([(1, 1, "pending"), (1, None, "pending"), (1, 1, "rejected"), (2, 1, "pending"), (3, 1, "pending"), (4, 1, "pending"), (9, 1, "pending"), (None, 1, "pending")], "run_id int, primary_id int, decision string")
    assert tuple(merge.run_aging(waiting, runs, at).head()) == (1, 1, 1) and tuple(merge.run_aging(waiting.limit(0), runs, at).head()) == (0, 0, 0)
    known = reports.counts_of_known(waiting, "decision", ("pending", "deferred"))
    assert {r["decision"]: r["n"] for r in known.collect()} == {"pending": 7, "deferred": 0}
