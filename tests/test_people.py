"""Scalars, sources, rules, matching, loading, merging and sampling on hand-made rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold.functions import picklists, scalar, similarity
from kinfold.operators import completeness, dq, load, mapping, match, merge, reports, sampling, search, survivorship
from kinfold.plans.people_import import CORE, ID_MAP, import_people
from kinfold.sources import crm, people_csv, sinks
from kinfold.streaming import incremental


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(
    ("raw", "email"), [(" Ann+News@X.org ", "ann@x.org"), ("", None), (None, None), ("plain", "plain"), ("a+b", "a+b")]
)
def test_email(spark, raw, email):
    assert one(spark, scalar.normalize_email(text(raw))) == (email,)


@pytest.mark.parametrize(
    ("raw", "phone"),
    [("(415) 555-0101", "+14155550101"), ("1-415-555-0101 ext 12", "+14155550101"), ("0044 20 7946 0000", "+442079460000"), ("+1 415.555.0101x9", "+14155550101"), ("555", None), ("", None), (None, None), ("+0123456789", None)],
)
def test_phone(spark, raw, phone):
    assert one(spark, scalar.normalize_phone(text(raw))) == (phone,)


def test_text_scalars(spark):
    got = one(
        spark,
        scalar.slugify(text("  Spring  Fair_2024! ")), scalar.slugify(text("!!")), scalar.csv_guard(text("=1+1")), scalar.parse_date_text(text("2024-05-06T07:08")), scalar.parse_datetime_text(text("2024-05-06T07:08")),
        scalar.parse_datetime_text(text("2024-05-06T07:08+02:00")), scalar.coerce_int(text("3.0")), scalar.coerce_int(text(" 12 ")), scalar.title_case(text("first_name")), scalar.record_key(text(""), text(None), F.lit(7), F.lit(1)),
    )
    assert got == ("spring-fair-2024", "event", "'=1+1", "2024-05-06", "2024-05-06T07:08Z", "2024-05-06T07:08+02:00", None, 12, "First Name", "seq-7")
    assert one(spark, scalar.split_semicolon(text("a; b ;;c")), scalar.flatten_list(text("a, b;c"))) == (["a", "b", "c"], ["a", "b", "c"])
    assert one(spark, scalar.loose_bool(text("Yes")), scalar.loose_bool(text(None)), scalar.filter_bool(text("maybe"), True), scalar.filter_bool(text("no"), True)) == (True, False, True, False)
    births = one(spark, *[scalar.parse_birthdate(text(v)).cast("string") for v in ("1990-02-19", "2/19/1990", "19/2/1990", "1990-02-30", "soon")])
    assert births == ("1990-02-19", "1990-02-19", "1990-02-19", None, None)
    day = lambda v: F.to_date(F.lit(v))
    assert one(spark, scalar.age(day("2000-06-15"), day("2024-06-14")), scalar.age(day("2000-06-15"), day("2024-06-15"))) == (23, 24)


def test_scores(spark):
    day = lambda v: F.to_date(text(v))
    near = one(spark, scalar.dob_proximity(day("1990-01-01"), day("1990-01-01")), scalar.dob_proximity(day("1990-01-01"), day("1991-01-01")), scalar.dob_proximity(day(None), day("1990-01-01")))
    assert near == (1.0, 0.5, 0.0)
    features = {"name": 1.0, "dob": 0.5, "address": 0.8, "employer": 0.6, "school": 0.4, "alternate_contact": 1.0}
    assert one(spark, F.round(scalar.weighted_score({k: F.lit(v) for k, v in features.items()}), 6)) == (0.77,)
    assert one(spark, scalar.clamped(F.lit(1.234)), scalar.clamped(F.lit(-0.4)), F.round(scalar.clamped(F.lit(0.87654)), 3)) == (1.0, 0.0, 0.877)
    assert one(spark, scalar.band(F.lit(0.95)), scalar.band(F.lit(0.6)), scalar.band(F.lit(0.59))) == ("high", "review", "low")
    a = F.array(F.lit("isabella.martinez+alumni@x.org"))
    none = F.array().cast("array<string>")
    assert one(spark, scalar.alternate_contact(a, none, F.array(F.lit("Isabella.Martinez@x.org")), none), scalar.alternate_contact(a, none, none, none)) == (1.0, 0.0)


def test_similarity():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    db = duckdb.connect()
    for a, b in zip(words[::2], words[1::2], strict=True):
        want = db.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert abs(similarity.jaro_winkler_text(a, b) - want) < 1e-9
    assert similarity.address_text("125 Palm St", "San Francisco", "94110", "125 Palm Street", "San Francisco", "94110") > 0.9
    assert similarity.token_sort_text("North Beach Tutoring", "North Beach Tutoring Center") > 0.7
    assert similarity.token_set_text("b a", "A, b!") == 1.0 and similarity.token_set_text("", "x") == 0.0
    for a, b in (("kitten", "sitting"), ("", "a"), ("abc", "abc")):
        rows = [[0] * (len(b) + 1)]
        for i, x in enumerate(a):
            rows.append([0])
            for j, y in enumerate(b):
                rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
        assert similarity.lcs_length(a, b) == rows[-1][-1]


def test_name_similarity(spark):
    rows = spark.createDataFrame([("Isabella", "Martinez", "isabella", "MARTINEZ"), ("Isabella", None, "Isabella", "M")], "a string, b string, c string, d string")
    assert [r[0] for r in rows.select(similarity.name_similarity(*map(F.col, "abcd"))).collect()] == [1.0, 0.0]


@pytest.mark.parametrize(
    ("fn", "raw", "want"),
    [
        ("race_ethnicity", "Hispanic/Latino", "hispanic_or_latino"), ("race_ethnicity", "unlisted", None), ("education_level", "Ph.D.", "doctorate"), ("education_level", "master of science", "associates"),
        ("age_group", "60-69", "senior"), ("age_group", "25 - 34 yrs", "adult"), ("age_group", "70 +", "senior"), ("age_group", "10-20", "teen"), ("organization_type", "City of X", "government"), ("organization_type", "zzz", "other"),
        ("session_type", "Campus Visit", "community_event"), ("session_status", "??", "requested"), ("event_format", "Online", "virtual"), ("cancellation_reason", "bad weather", "weather"), ("event_format", "", None),
    ],
)
def test_picklists(spark, fn, raw, want):
    assert one(spark, getattr(picklists, f"normalize_{fn}")(text(raw))) == (want,)


HEAD = "external_system,external_id,first_name,last_name,email,phone,source_updated_at\n"
VALID = HEAD + "csv,vol-001,Eleanor,Rigby,eleanor@x.org,+14155550101,\ncsv,vol-002,Maxwell,Edison,max@x.org,+14155550102,\ncsv,vol-003,Prudence,Jones,pru@x.org,,\n"


def put(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_headers():
    assert people_csv.resolve_headers(["﻿First", "Surname", "E-Mail Address".replace("E-Mail", "Email")]) == ["first_name", "last_name", "email"]
    for bad in (["first"], ["first", "last", "what"], ["first", "last", "email", "primary email"]):
        with pytest.raises(people_csv.HeaderError):
            people_csv.resolve_headers(bad)
    with pytest.raises(KeyError):
        people_csv.reader("letters")


def test_csv_gaps(spark, tmp_path):
    path = put(tmp_path, "a.csv", "First,Last,Email\n Ann , Lee ,a@x.org\n,,\nBo,Li,\n")
    rows = people_csv.read_people(spark, path).collect()
    assert [(r["sequence_number"], r["first_name"], r["last_name"]) for r in rows] == [(1, "Ann", "Lee"), (3, "Bo", "Li")]
    stats = {r["field"]: r["populated"] for r in people_csv.column_population(people_csv.read_people(spark, path), ["first_name", "email"]).collect()}
    assert stats == {"first_name": 2, "email": 1}


def test_csv_folder_and_counts(spark, tmp_path):
    for n in ("a", "b"):
        put(tmp_path, f"{n}.csv", f"First,Last,Email\n{n}1,X,\n,,\n{n}2,X,\n")
    rows = people_csv.read_people(spark, str(tmp_path), skip_blank=False)
    assert {r["sequence_number"]: r["first_name"] for r in rows.collect()} == {1: "a1", 2: None, 3: "a2", 4: "b1", 5: None, 6: "b2"}
    assert tuple(people_csv.scan_counts(rows).head()) == (6, 2, 4)
    odd = spark.createDataFrame([(" Ann ", "9", "Lee")], "`Given Name` string, shoe string, surname string")
    assert people_csv.canonical(odd).head().asDict() == {"first_name": "Ann", "last_name": "Lee"} and people_csv.missing_headers(["shoe", "Surname"]) == ["first_name"]


def test_crm_order_and_pages(spark, tmp_path):
    raw = spark.createDataFrame([("1", "B", None, "2024-01-01"), ("2", "A", "Business", "2024-01-02"), ("3", "C", "School", "2024-01-03")], "Id string, Name string, Type string, SystemModstamp string")
    assert [r["Id"] for r in crm.accounts(raw).collect()] == ["2", "1"] and [r["Id"] for r in crm.accounts(raw, "2024-01-01", 1).collect()] == ["2"]
    starts = spark.createDataFrame([("1", "Confirmed", "Fair", "2024-01-01", "2024-01-01"), ("2", "Confirmed", None, "2024-02-01", "2024-01-01"), ("3", "Draft", "Fair", None, "2024-01-01")], "Id string, Session_Status string, Session_Type string, Start string, SystemModstamp string")
    assert [r["Id"] for r in crm.sessions(starts).collect()] == ["2", "1"]
    links = spark.createDataFrame([("9", "1", "2024-01-01"), ("8", "2", "2024-01-02")], "Id string, Contact string, SystemModstamp string")
    people = spark.createDataFrame([("1", "Student"), ("2", "")], "Id string, Type string")
    assert [r["Id"] for r in crm.affiliations(links, people).collect()] == ["8"] and [r["Id"] for r in crm.affiliations(links, people, volunteers_only=False).collect()] == ["9", "8"]
    crm.pages(raw.coalesce(1), str(tmp_path / "pages"), 2)
    assert people_csv.reader("crm_accounts")(spark, str(tmp_path / "pages")).count() == 3 and len(list((tmp_path / "pages").glob("*.csv"))) == 2


def run(spark, tmp_path, body, core=None, id_map=None, run_id=1):
    core = core if core is not None else spark.createDataFrame([], CORE)
    id_map = id_map if id_map is not None else spark.createDataFrame([], ID_MAP)
    return import_people(spark, put(tmp_path, f"r{run_id}.csv", body), run_id, core, id_map, F.to_timestamp(F.lit("2024-01-01")))


def actions(out):
    return {r["load_action"]: r["n"] for r in load.summary(out["loaded"]).collect()}


def test_golden_runs(spark, tmp_path):
    first = run(spark, tmp_path, VALID)
    assert actions(first) == {"inserted": 3} and first["violations"].count() == 0
    again = run(spark, tmp_path, VALID, first["core"], first["id_map"], 2)
    assert actions(again) == {"skipped_no_change": 3} and again["core"].count() == 3 and again["change_log"].count() == 0
    lost = run(spark, tmp_path, VALID, first["core"].filter("first_name <> 'Maxwell'"), first["id_map"], 8)
    assert actions(lost) == {"skipped_no_change": 3} and lost["core"].count() == 3
    moved = VALID.replace("max@x.org", "maxwell@x.org")
    third = run(spark, tmp_path, moved, first["core"], first["id_map"], 6)
    assert actions(third) == {"skipped_no_change": 2, "updated": 1}
    assert [tuple(r)[2:] for r in third["change_log"].collect()] == [("email", "max@x.org", "maxwell@x.org")]
    assert sorted(r["email"] for r in third["core"].collect()) == ["eleanor@x.org", "maxwell@x.org", "pru@x.org"]
    dry = import_people(spark, put(tmp_path, "dry.csv", VALID), 9, spark.createDataFrame([], CORE), spark.createDataFrame([], ID_MAP), F.to_timestamp(F.lit("2024-01-01")), dry_run=True)
    total = dry["summary"].head()
    assert (total["rows_processed"], total["rows_created"], total["potential_inserts"]) == (3, 0, 3) and dry["core"].count() == 0
    near = HEAD + "csv,f-1,Prudense,Jones,other@x.org,,\ncsv,f-2,Prudence,Jones,new@x.org,,\ncsv,f-3,Someone,Else,new@x.org,,\n"
    out = run(spark, tmp_path, near, first["core"], first["id_map"], 7)
    assert {r["clean_id"]: (r["load_action"], r["skip_reason"]) for r in out["loaded"].collect()} == {1: ("skipped_duplicate_fuzzy", "DUPLICATE_FUZZY"), 2: ("skipped_duplicate", "DUPLICATE_NAME"), 3: ("deterministic_update", None)}
    assert {(r["match_type"], r["score"], r["decision"]) for r in out["suggestions"].collect()} == {("fuzzy_name", 0.95, "pending"), ("deterministic", 1.0, "auto_merged")}
    assert {(r["email"], r["is_primary"]) for r in out["emails"].filter("email = 'new@x.org'").collect()} == {("new@x.org", True)}
    assert sorted(r["record_key"] for r in out["skips"].collect()) == ["prudence jones", "prudense jones"]
    other = HEAD + "csv,n-1,El,R,eleanor@x.org,,\ncsv,n-2,Mx,E,,+14155550102,\n"
    assert actions(run(spark, tmp_path, other, first["core"], first["id_map"], 3)) == {"deterministic_update": 2}
    twice = HEAD + "csv,d-1,Samantha,Stone,sam@x.org,+14155550109,\ncsv,d-2,Sammy,Stone,sam@x.org,+14155550109,\n"
    assert actions(run(spark, tmp_path, twice, run_id=4)) == {"inserted": 1, "deterministic_update": 1}
    bad = HEAD + "csv,i-1,No,Contact,,,\ncsv,i-2,Bad,Mail,not-an-email,+1555,\ncsv,i-3,No,Plus,ok@x.org,4155555104,\n"
    out = run(spark, tmp_path, bad, run_id=5)
    assert {r["rule_code"]: r["n"] for r in dq.rule_counts(out["violations"]).collect()} == {"VOL_EMAIL_FORMAT": 1, "VOL_PHONE_E164": 2}
    assert out["clean"].count() == 1


def plain_loads(clean, core, id_map):
    """Row by row."""
    people, out, base = [{**c, "mails": {c["mail"]} - {None}} for c in core], {}, max((c["person_id"] for c in core), default=0)
    maps = {(m["external_system"], m["external_id"]): m for m in id_map}
    near = lambda a, b: a.split()[-1] == b.split()[-1] and a[0] == b[0] and similarity.jaro_winkler_text(a, b) >= load.NEAR_NAME
    for r in sorted(clean, key=lambda r: r["clean_id"]):
        m = maps.get((r["external_system"], r["external_id"]))
        if not (r["external_id"] or "").strip():
            out[r["clean_id"]] = ("error_missing_external_id", None)
        elif m:
            out[r["clean_id"]] = ("updated" if m["is_active"] else "reactivated", m["entity_id"])
        else:
            e = {p["person_id"] for p in people if r["mail"] in p["mails"]}
            p = {p["person_id"] for p in people if r["phone"] is not None and p["phone"] == r["phone"]}
            n = {p["person_id"] for p in people if r["name"] is not None and p["name"] == r["name"]}
            f = {p["person_id"] for p in people if r["name"] and p["name"] and near(r["name"], p["name"])}
            both = e & p
            match_ = min(both) if len(both) == 1 else min(e | p) if not both and len(e) + len(p) == 1 else None
            if match_ is not None:
                out[r["clean_id"]] = ("deterministic_update", match_)
            elif e:
                out[r["clean_id"]] = ("skipped_duplicate", min(e))
            elif n:
                out[r["clean_id"]] = ("skipped_duplicate", min(n))
                if r["mail"]:
                    next(q for q in people if q["person_id"] == min(n))["mails"].add(r["mail"])
            elif f:
                out[r["clean_id"]] = ("skipped_duplicate_fuzzy", min(f))
            else:
                ident = base + r["clean_id"]
                people.append({"person_id": ident, "phone": r["phone"], "name": r["name"], "mails": {r["mail"]} - {None}})
                out[r["clean_id"]] = ("inserted", ident)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_load_order(spark, seed):
    rng = random.Random(seed)
    pick = lambda kind, n: rng.choice([None, *[f"{kind}{i}" for i in range(n)]])
    named = lambda: rng.choice([None, *[f"{f} {l}" for f in ("christopher", "christophe", "christoph", "anna", "annabel") for l in ("bell", "bells", "gray")]])  # noqa: E731, E741
    clean = [{"clean_id": i, "external_system": "s", "external_id": rng.choice([None, f"x{i}", f"x{i}"]), "mail": pick("m", 30), "phone": pick("p", 30), "name": named()} for i in range(1, 60)]
    core = [{"person_id": i, "mail": pick("m", 12), "phone": pick("p", 12), "name": named()} for i in range(1, 5)]
    id_map = [{"external_system": "s", "external_id": f"x{i}", "entity_id": 1, "is_active": i % 2 == 0} for i in range(5, 12)]
    last = F.element_at(F.split("name", " "), -1).alias("last")
    schema = "clean_id long, external_system string, external_id string, mail string, phone string, name string"
    got = load.decide_loads(
        spark.createDataFrame([tuple(r.values()) for r in clean], schema).select("*", last), spark.createDataFrame([tuple(r.values()) for r in core], "person_id long, mail string, phone string, name string").select("*", last),
        spark.createDataFrame([tuple(r.values()) for r in id_map], "external_system string, external_id string, entity_id long, is_active boolean"),
    ).collect()
    assert {r["clean_id"]: (r["load_action"], r["entity_id"]) for r in got} == plain_loads(clean, core, id_map)


def test_long_chains_have_no_limit(spark):
    """Each row shares an address with the row before and a number with the one after."""
    rows = [(i, "s", f"x{i}", f"m{(i + 1) // 2}", f"p{i // 2}", None) for i in range(1, 13)]
    clean = spark.createDataFrame(rows, "clean_id long, external_system string, external_id string, mail string, phone string, name string")
    core = spark.createDataFrame([], "person_id long, mail string, phone string, name string")
    got = load.decide_loads(clean, core, spark.createDataFrame([], "external_system string, external_id string, entity_id long, is_active boolean")).collect()
    want = plain_loads([dict(zip(("clean_id", "external_system", "external_id", "mail", "phone", "name"), r, strict=True)) for r in rows], [], [])
    assert {r["clean_id"]: (r["load_action"], r["entity_id"]) for r in got} == want


def test_mapping_errors():
    for rows in ([{"target": "a", "source": "x"}, {"target": "a", "source": "y"}], [{"target": "a"}], [{"target": "a", "source": "x", "transform": "nope"}]):
        with pytest.raises(ValueError):
            mapping.Spec.of("s", rows)
    assert mapping.Spec.load('{"name": "s", "fields": [{"target": "a", "source": "x"}]}').checksum


def test_events_and_organizations(spark):
    rows = spark.createDataFrame([("t", "2024-01-02", "2024-01-01"), (" ", "", None), ("t", "2024-01-01", "later")], "title string, start_date string, end_date string")
    got = [[v["rule_code"] for v in r["violations"]] for r in dq.judge(rows, dq.event_rules()).collect()]
    assert got == [["EVENT_DATE_VALIDATION"], ["EVENT_TITLE_REQUIRED", "EVENT_START_DATE_REQUIRED"], []]
    named = spark.createDataFrame([("x",), (" ",)], "name string")
    assert [r["status"] for r in dq.judge(named, dq.organization_rules()).collect()] == ["validated", "quarantined"]
    warned = dq.judge(spark.createDataFrame([(None, None)], "email string, phone string"), dq.person_rules(contact_required=True))
    assert warned.first()["status"] == "validated"


def test_crm_filters(spark):
    raw = spark.createDataFrame([("1", "Volunteer", "2024-01-02T00:00:00Z"), ("2", None, "2024-01-01T00:00:00Z"), ("3", "Student", "2024-01-03T00:00:00Z")], "Id string, Type string, SystemModstamp string")
    assert [r["Id"] for r in crm.contacts(raw).collect()] == ["2", "1"]
    assert [r["Id"] for r in crm.contacts(raw, "2024-01-01T00:00:00Z").collect()] == ["1"]
    assert crm.accounts(raw.withColumn("Type", F.lit("School"))).count() == 0
    links = spark.createDataFrame([("a", "1", "2024-01-05"), ("b", "3", "2024-01-05")], "Id string, Contact string, SystemModstamp string")
    assert [r["Id"] for r in crm.affiliations(links, raw).collect()] == ["a"]


def test_candidates(spark):
    people = spark.createDataFrame([(i, "a@x" if i == 1 else None, None, "lee", "a", "1" if i < 3 else None) for i in range(1, 30)], "person_id long, email string, phone string, last string, initial string, postal_code string")
    rows = spark.createDataFrame([(1, "a@x", None, "lee", "a", "1"), (2, None, None, "lee", "a", None), (3, None, None, "zed", "a", None)], "row_id long, email string, phone string, last string, initial string, postal_code string")
    got = sorted((r["row_id"], r["person_id"]) for r in match.candidates(rows, people).collect())
    assert got == [(1, 1), (1, 2), *[(2, i) for i in range(1, 11)]]


def test_survivorship_order(spark):
    rows = spark.createDataFrame([(1, None, "v", "i", "c"), (2, "m", None, "i", "c"), (3, " ", None, None, None)], "k int, manual_email string, verified_core_email string, incoming_email string, existing_core_email string")
    got = [tuple(r["email"]) for r in survivorship.apply_survivorship(rows, keep=("k",)).collect()]
    assert got == [("v", "verified_core", True), ("m", "manual", True), (None, "manual", False)]


def test_merge_steps(spark):
    people = spark.createDataFrame([(1, None, "a@x"), (2, "Bo", "b@x"), (3, "Cy", None)], "person_id long, first_name string, email string")
    pairs = spark.createDataFrame([(9, 1, 2)], "suggestion_id long, primary_id long, candidate_id long")
    after, log = merge.merge_people(people, pairs)
    assert sorted(map(tuple, after.collect())) == [(1, "Bo", "a@x"), (3, "Cy", None)]
    assert sorted(map(tuple, merge.undo_merge(after, log).collect()), key=str) == sorted(map(tuple, people.collect()), key=str)
    assert sorted(map(tuple, merge.undo_merge(people, log).collect()), key=str) == sorted(map(tuple, people.collect()), key=str)
    ids = spark.createDataFrame([(2, "x")], "entity_id long, external_id string")
    assert [(r["entity_id"], r["came_from"]) for r in merge.repoint(ids, log).collect()] == [(1, 2)]
    hand = spark.createDataFrame([(9, {"first_name": "Di"})], "suggestion_id long, overrides map<string,string>")
    assert merge.merge_people(people, pairs, overrides=hand)[0].filter("person_id = 1").first()["first_name"] == "Di"


def test_sampling(spark):
    assert [sampling.sample_size(n) for n in (0, 5, 10, 50, 99, 100, 500, 10_000)] == [0, 5, 10, 10, 10, 20, 26, 50]
    assert [sampling.sample_size(10**6, n) for n in (5, 25, 100)] == [10, 25, 50]
    rows = sampling.with_completeness(spark.range(90).select("id", F.when(F.col("id") % 3 == 0, "x").alias("a"), F.when(F.col("id") % 2 == 0, "y").alias("b")), ["a", "b"])
    few = sampling.stratified(rows, "level", {"high": 5, "medium": 5, "low": 5}, "id")
    assert {r["level"]: r["count"] for r in few.groupBy("level").count().collect()} == {"high": 5, "medium": 5, "low": 5}
    assert sorted(few.collect()) == sorted(sampling.stratified(rows.repartition(7), "level", {"high": 5, "medium": 5, "low": 5}, "id").collect())
    assert sampling.field_samples(rows, "nope", 3).count() == 0 and sampling.field_gaps(rows, "a", "id", 4).count() == 4


def test_slugs_after_taken(spark):
    rows = spark.createDataFrame([(1, "fair"), (2, "fair"), (3, "new")], "id long, base string")
    taken = spark.createDataFrame([("fair",), ("fair-3",)], "slug string")
    assert [r["slug"] for r in load.unique_slugs(rows, "base", "id", taken).orderBy("id").collect()] == ["fair-1", "fair-2", "new"]
    rng = random.Random(3)
    bases = [rng.choice(["fair", "fair-1", "fair-2", "gala", "fair-1-1"]) for _ in range(40)]
    got = [r["slug"] for r in load.unique_slugs(spark.createDataFrame(list(enumerate(bases)), "id long, base string"), "base", "id", taken).orderBy("id").collect()]
    assert len(set(got)) == 40 and not set(got) & {"fair", "fair-3"}
    assert all(g == b or re.fullmatch(re.escape(b) + "-[1-9][0-9]*", g) for g, b in zip(got, bases, strict=True))
    assert sorted(g for g, b in zip(got, bases, strict=True) if b == "gala") == sorted(["gala", *[f"gala-{i}" for i in range(1, bases.count("gala"))]])


def test_search_parts(spark):
    people = spark.createDataFrame([(1, "Ann"), (2, "Bo")], "id long, name string")
    mails = spark.createDataFrame([(2, "bo@x", True, 5), (2, "alt@x", False, 4), (1, "z@x", False, 9)], "person long, email string, main boolean, k int")
    assert [r["id"] for r in search.multi_search(people, "id", "X", ["name"], [(mails, "person", "email")]).collect()] == [1, 2]
    assert {r["id"]: r["email"] for r in search.with_primary(people, "id", mails, "person", "email", "main", "k").collect()} == {1: None, 2: "bo@x"}
    assert {r["person"]: r["email"] for r in search.first_child(mails, "person", "email", F.col("main"), "k").collect()} == {1: "z@x", 2: "bo@x"}
    with pytest.raises(ValueError):
        reports.sorted_page(people, "secret", {"name": "name"}, "id", 1, 10)
    grants = spark.createDataFrame([(1, "read"), (1, "write"), (2, "read")], "role_id long, permission string")
    links = spark.createDataFrame([(7, 70, 2, True), (8, 70, 1, False)], "user_id long, organization_id long, role_id long, is_active boolean")
    users = spark.createDataFrame([(7, False), (9, True)], "user_id long, is_super_admin boolean")
    assert sorted((r["user_id"], r["permission"]) for r in search.permissions_of(users, links, grants).collect()) == [(7, "read"), (9, "read"), (9, "write")]


def test_remediation(spark):
    rows = spark.sql("select 'R1' rule_code, array(named_struct('at', 5, 'outcome', 'success', 'rule_codes', array('Z'), 'diff', map('email', 'x')), named_struct('at', 1, 'outcome', 'success', 'rule_codes', array('Z'), 'diff', map('phone', 'x')), named_struct('at', 6, 'outcome', 'failed', 'rule_codes', array('A', 'B'), 'diff', map('email', 'y'))) audit")
    got = sorted((r["field"], r["outcome"], r["rule_code"], r["n"]) for r in reports.remediation_stats(rows, F.lit(2)).collect())
    assert got == [("email", "failed", "A", 1), ("email", "failed", "B", 1), ("email", "success", "R1", 1)]


def test_empty_entities(spark):
    none = spark.createDataFrame([], "a string, b int")
    rows = completeness.field_completeness(none, ["a", "b"]).withColumn("entity", F.lit("x"))
    assert {r["percent"] for r in rows.collect()} == {0.0}
    assert completeness.health_score(completeness.entity_completeness(rows)).first()[0] == 0.0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=x", 1), ("y", 2)], "a string, b int")
    sinks.write_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, back)) == [("'=x", "1"), ("y", "2")]
    assert one(spark, F.lit(1)) and spark.sql("select map('b', '2', 'a', null) m").select(sinks.flattened("m")).first()[0] == "a=; b=2"


def test_increments(spark, tmp_path):
    marks = incremental.Watermarks(spark, f"file://{tmp_path}/marks")
    assert marks.get("crm", "contact") is None
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-03",)], "stamp string")
    marks.put("crm", "contact", incremental.advance(rows, "stamp", None))
    assert marks.get("crm", "contact") == "2024-01-03"
    assert incremental.after_mark(rows, "stamp", "2024-01-01").count() == 1
    assert incremental.advance(rows.limit(0), "stamp", "k") == "k"
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = incremental.stream_files(spark, str(tmp_path / "in"), rows.schema, lambda batch, _: seen.append(batch.count()), str(tmp_path / "state"))
    stream.awaitTermination()
    assert sum(seen) == 2
