"""Run services, exports, profiles, candidates, scans, remediation and merges on hand-made rows."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.functions import scalar, similarity
from kinfold.operators import completeness, crm_load, load, match, merge, remediate, runs, sampling, search, survivorship
from kinfold.operators.ranking import number_within
from kinfold.sources import crm_pages, exports
from kinfold.streaming import incremental

FIELDS = "first_name string, last_name string, dob string, street string, city string, postal_code string, employer string, school string, emails array<string>, phones array<string>"


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    ("text", "mail"),
    [("{'home': 'A@x.org', 'work': 'b@x.org'}", "a@x.org"), ('{"primary": " ", "work": "b@x.org"}', "b@x.org"), (" C@x.org ", "c@x.org"), ("", None), (None, None), ("{broken", "{broken")],
)
def test_extract_email(spark, text, mail):
    assert one(spark, scalar.extract_email(F.lit(text).cast("string"))) == (mail,)


def test_scalars(spark):
    t = lambda v: F.lit(v).cast("string")
    assert one(spark, scalar.compose_notes(t("IT"), t("Likes cats"), t("Java")), scalar.compose_notes(t("IT"), t(""), t(None)), scalar.compose_notes(t(None), t(None), t(""))) == ("Likes cats\nSkills: Java", "Department: IT", None)
    assert one(spark, scalar.display_name(t("dr."), t(None), t("Ann"), t("Lee")), scalar.display_name(t("dr"), t("Annie"), t("Ann"), t("Lee")), scalar.display_name(t(None), t(None), t("Ann"), t("Lee"))) == ("Dr. Ann Lee", "Annie", "Ann Lee")
    assert one(spark, scalar.to_list(F.array(t("a"), t(" ")), t("b; c,")), scalar.to_list(None, t(None))) == (["a", "b", "c"], [])
    days = one(spark, *[F.date_format(scalar.filter_date(t(v), e), "yyyy-MM-dd HH:mm:ss") for v, e in (("2024-02-03", False), ("2024-02-03", True), ("2/3/2024", False), ("2024-02-03T04:05:06", True), ("soon", False))])
    assert days == ("2024-02-03 00:00:00", "2024-02-03 23:59:59", "2024-02-03 00:00:00", "2024-02-03 04:05:06", None)
    a, b = {"x": t("1"), "y": t(None)}, {"y": t(None), "x": t("1")}
    assert one(spark, scalar.checksum(a) == scalar.checksum(b), scalar.checksum({"x": t("1\x1fy=v2"), "y": t("3")}) == scalar.checksum({"x": t("1"), "y": t("2\x1f3")})) == (True, False)
    stamped = {"a": t("1"), "source_modstamp": t("now")}
    assert one(spark, scalar.payload_hash(stamped, scalar.VOLATILE) == scalar.payload_hash({"a": t("1")}), scalar.payload_hash(stamped) == scalar.payload_hash({"a": t("1")})) == (True, False)
    yes, no = F.lit(True), F.lit(False)
    assert one(spark, scalar.can_contact("email", no, no, no, no, yes, no), scalar.can_contact("email", no, no, yes, no, yes, no), scalar.can_contact("phone", yes, no, no, no, yes, yes), scalar.can_contact("phone", no, no, no, no, yes, no)) == (True, False, False, False)
    day = lambda v: F.lit(v).cast("date")
    assert one(spark, scalar.hours_in_range(day("2024-01-02"), day("2024-01-02"), day(None)), scalar.hours_in_range(day("2024-01-02"), day(None), day("2024-01-01"))) == (True, False)
    assert one(spark, scalar.enum_or(t("VIRTUAL"), ("virtual",), "in_person"), scalar.enum_or(t("?"), ("virtual",), "in_person")) == ("virtual", "in_person")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcdé ", max_size=9), st.text("abcdé ", max_size=9)), min_size=1, max_size=8))
def test_jaro_winkler_together(pairs):
    got = similarity.jaro_winkler_together([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([similarity.jaro_winkler_text(a, b) for a, b in pairs], abs=1e-12)


def test_number_within_spreads_one_group(spark):
    rows = spark.range(1000).select(F.lit("all").alias("g"), (F.col("id") * 7 % 1000).alias("k"))
    got = number_within(rows, ["g"], ["k"]).collect()
    assert all(r["n"] == r["k"] for r in got) and len(got) == 1000
    assert sorted(r["n"] for r in number_within(rows, [], ["k"]).collect()) == list(range(1000))


def test_filters_and_pages(spark):
    with pytest.raises(ValueError, match="status"):
        runs.Filters(status=("what",)).checked(("open",))
    assert runs.Filters(page=-1, size=5000).checked((), 200).size == 200
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(7)], "id int, s string")
    got = runs.page_with_total(rows, "s", {"s": "s"}, "id", 2, 3).collect()
    assert [(r["id"], r["total"], r["pages"]) for r in got] == [(1, 7, 3), (4, 7, 3), (2, 7, 3)]


def test_artifact(spark, tmp_path):
    changes = spark.createDataFrame([(2, 0, 0, 5)], "rows_created int, rows_updated int, rows_reactivated int, touched int")
    got = exports.write_artifact(exports.run_artifact(changes, 3, True), str(tmp_path / "artifact"))
    assert got["diff"] == "created" and got["counts"]["touched"] == 5 and json.loads((next((tmp_path / "artifact").glob("part-*"))).read_text())["run_id"] == 3


def test_profile():
    p = survivorship.load_profile('{"tiers": ["manual", "incoming"], "own": {"notes": ["existing_core"], "email": ["verified_core"]}}')
    assert p.order("first_name") == ("manual", "incoming", "existing_core") and p.order("notes") == ("existing_core", "incoming") and p.order("email") == ("verified_core", "existing_core", "incoming")
    for bad in ('{"tiers": ["luck"]}', '{"own": {"shoe": ["manual"]}}', '{"groups": {"a": ["x"], "b": ["x"]}}'):
        with pytest.raises(ValueError):
            survivorship.load_profile(bad)


def test_config():
    known = {"contact": ["email", "first_name"]}
    assert completeness.checked_config({"contact": ["email"]}, known) == {"contact": {"email"}}
    assert completeness.display_config(known, {"contact": {"email"}})["contact"][1] == {"field": "first_name", "label": "First Name", "enabled": True}
    for bad in ({"contact": ["shoe"]}, {"shoe": []}):
        with pytest.raises(ValueError):
            completeness.checked_config(bad, known)


def people(spark, rows):
    return spark.createDataFrame(rows, "person_id long, " + FIELDS)


def test_candidates_and_features(spark):
    ann = ("Annabel", "Lee", "1990-01-01", "1 Main St", "KC", "64111", "Acme", "North High", ["a@x.org"], ["+18165550100"])
    core = people(spark, [(1, *ann), (2, "Bob", "Stone", None, None, None, None, None, None, None, None)])
    rows = [(10, False, "Annabell", *ann[1:]), (11, False, "Annabel", "Lee", None, None, None, None, None, None, None, None), (12, True, *ann), (13, False, "Zed", "Zulu", "1990-01-01", None, None, "1", None, None, None, None)]
    incoming = spark.createDataFrame(rows, "row_id long, matched boolean, " + FIELDS)
    new, counts = match.generate_candidates(incoming, core, spark.createDataFrame([], "row_id long, person_id long"))
    assert [(r["row_id"], r["person_id"], r["match_type"]) for r in new.collect()] == [(10, 1, "high")]
    got = counts.head().asDict()
    assert got == {"rows_considered": 4, "skipped_no_signals": 1, "skipped_deterministic": 1, "skipped_no_candidates": 1, "suggestions_created": 1, "high_pairs": 1, "review_pairs": 0, "low_pairs": 0}
    again, _ = match.generate_candidates(incoming, core, spark.createDataFrame([(10, 1)], "row_id long, person_id long"))
    assert again.count() == 0
    f = new.select("dob", "address", "employer", "school", "alternate_contact").head()
    assert tuple(f) == (1.0, 1.0, 1.0, 1.0, 1.0)


def test_scan(spark):
    none = [None] * 8
    rows = [(1, "Christopher", "Bell", *none), (2, "Christophe", "Bell", "1990-01-01", *none[1:]), (3, "Christopher", "Bell", "1990-01-01", *none[1:]), (4, "Zoe", "Bell", *none), (5, None, "Bell", *none)]
    got = match.scan_duplicates(people(spark, rows), spark.createDataFrame([], "primary_id long, candidate_id long")).collect()
    assert [(r["primary_id"], r["candidate_id"], r["score"], r["match_type"]) for r in got] == [(1, 3, 0.9, "review")]


def test_merge_chain_and_undo(spark):
    rows = spark.createDataFrame([(1, "Ann", None, "a@x.org"), (2, None, "Lee", "b@x.org"), (3, "Anna", "Li", None), (4, "Bo", None, None)], "person_id long, first_name string, last_name string, email string")
    pairs = spark.createDataFrame([(1, 2, 3), (2, 1, 2)], "suggestion_id long, primary_id long, candidate_id long")
    flat = merge.resolved_pairs(pairs)
    assert {tuple(r) for r in flat.collect()} == {(1, 1, 3), (2, 1, 2)}
    after, log = merge.merge_people(rows, flat)
    assert {tuple(r) for r in after.collect()} == {(1, "Ann", "Li", "a@x.org"), (4, "Bo", None, None)}
    assert {tuple(r) for r in merge.undo_merge(after, log).collect()} == {tuple(r) for r in rows.collect()}
    maps = spark.createDataFrame([("c", "x1", 3), ("c", "x2", 4)], "entity_type string, external_id string, entity_id long")
    assert {tuple(r) for r in merge.repointed_rows(maps, log).collect()} == {("c", "x1", 3, 1)}
    moved = merge.repoint(maps, log)
    assert {(r["external_id"], r["entity_id"]) for r in merge.undo_repoint(moved, log).collect()} == {("x1", 3), ("x2", 4)}
    ring = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "suggestion_id long, primary_id long, candidate_id long")
    assert {tuple(r)[1:] for r in merge.resolved_pairs(ring).collect()} == {(1, 2)}


def test_sweep(spark):
    rows = spark.createDataFrame([(i, f"N{i}", None, None) for i in range(1, 6)], "person_id long, first_name string, last_name string, email string")
    suggestions = spark.createDataFrame([(1, 1, 2, 0.99, "high", "pending"), (2, 3, 4, 0.97, "high", "pending"), (3, 1, 5, 0.7, "review", "pending")], "suggestion_id long, primary_id long, candidate_id long, score double, match_type string, decision string")
    maps = spark.createDataFrame([("c", "x", 4)], "entity_type string, external_id string, entity_id long")
    out = merge.sweep(rows, suggestions, maps, 1)
    assert {r["person_id"] for r in out["people"].collect()} == {1, 3, 4, 5}
    assert {r["suggestion_id"]: r["decision"] for r in out["suggestions"].collect()} == {1: "auto_merged", 2: "pending", 3: "pending"}


def test_remediation(spark):
    payload = {"external_id": "x1", "first_name": "Ann", "last_name": "Lee", "email": "bad", "phone": "+18165550100"}
    violations = spark.createDataFrame([(1, "open", payload), (2, "fixed", payload), (3, "open", None), (4, "open", payload)], "violation_id long, status string, payload map<string,string>")
    edits = spark.createDataFrame([(1, {"email": "ann@x.org", "shoe": "9"}), (2, {"email": "ann@x.org"}), (3, {"email": "ann@x.org"}), (4, {"email": "worse"}), (9, {})], "violation_id long, edits map<string,string>")
    core = spark.createDataFrame([(7, "Old", "Lee", "old@x.org", "+18165550100", None, False, "manual", "old lee")], "person_id long, first_name string, last_name string, email string, phone_e164 string, notes string, email_verified boolean, source string, name string")
    id_map = spark.createDataFrame([("manual", "x1", 7, True)], "external_system string, external_id string, entity_id long, is_active boolean")
    out = remediate.remediate(violations, edits, core, id_map, F.to_timestamp(F.lit("2024-01-01")))
    got = {r["violation_id"]: (r["outcome"], r["load_action"]) for r in out["results"].collect()}
    assert got == {1: ("succeeded", "updated"), 2: ("not_open", None), 3: ("detached", None), 4: ("validation_failed", None), 9: ("not_found", None)}
    assert {r["violation_id"]: r["status"] for r in out["violations"].collect()} == {1: "fixed", 2: "fixed", 3: "open", 4: "open"}
    assert out["core"].select("first_name", "email").head() == ("Ann", "ann@x.org")
    entries = {r["violation_id"]: (r["outcome"], r["fields"]) for r in remediate.audit_entries(out["results"], 5, F.current_timestamp()).collect()}
    assert entries[1] == ("success", ["email"]) and entries[4] == ("validation_failed", ["email"]) and entries[2] == ("not_open", [])


def test_serialized_and_samples(spark):
    rows = spark.createDataFrame([(1, "T", "d" * 130)], "event_id int, title string, description string")
    assert json.loads(sampling.serialized(rows, "event").head()["record"])["description"] == "d" * 100 + "..."
    with pytest.raises(KeyError):
        sampling.serialized(rows, "shoe")


def test_staging_stats_and_loader_marks(spark):
    rows = spark.createDataFrame([("a", " ", None, "2024-01-02"), ("b", "m@x.org", None, "2024-01-03")], "id string, email string, phone string, modstamp string")
    staged = crm_load.staged(rows, 1, "contact", "id")
    assert tuple(crm_load.staging_stats(staged, "missing_contact_info").head()) == (2, "2024-01-03", 1)
    sessions = spark.createDataFrame([("a", "2024-01-01T10:00:00Z", "2024-01-01T11:30:00Z")], "id string, start_date string, end_date string")
    assert crm_load.staged(sessions, 1, "session", "id").head()["duration"] == 90
    stamps = spark.createDataFrame([("2024-01-02", None), ("2024-01-03", "2024-02-01")], "source_modstamp string, source_last_modified string")
    assert tuple(crm_load.high_water(stamps).head()) == ("2024-01-03", "2024-02-01")


def test_search_extras(spark):
    orgs = spark.createDataFrame([(1, "Alpha", "alpha", True), (2, "Alps", "alps", True), (3, "Alto", "alto", False)], "id int, name string, slug string, is_active boolean")
    members = spark.createDataFrame([(5, 2, True), (5, 1, False)], "user_id int, organization_id int, is_active boolean")
    assert [r["id"] for r in search.autocomplete_for(orgs, "al", members, 5, False).collect()] == [2]
    assert [r["id"] for r in search.autocomplete_for(orgs, "al", members, 5, True).collect()] == [1, 2]
    assert search.by_slug(orgs, "alps").count() == 1
    events = spark.createDataFrame([("Fair", None, "Main Hall"), ("Gala", None, None)], "title string, description string, location string")
    assert search.event_search(events, "HALL").count() == 1
    names = spark.createDataFrame([("ann_lee",), ("x",)], "u string")
    assert [r[0] for r in names.select(search.username_ok("u")).collect()] == [True, False]


def test_load_reports(spark):
    rows = spark.createDataFrame([("DUPLICATE_EMAIL", "a@x.org"), ("DUPLICATE_EMAIL", "a@x.org"), (None, "b@x.org")], "skip_reason string, mail string")
    assert [tuple(r) for r in load.duplicate_emails(rows).collect()] == [("a@x.org", 2)]
    diff = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    assert set(diff.select(load.payload_diff("x", "y").alias("d")).head()["d"]) == {"b", "c"}


def test_crm_pages(spark, tmp_path):
    spark.dataSource.register(crm_pages.CrmPages)
    (tmp_path / "a.csv").write_text('Id,Name,More\n1,"A, B",x\n2,,y\n')
    (tmp_path / "b.csv").write_text("Id\n3\n")
    (tmp_path / "job.json").write_text('{"state": "JobComplete"}')
    rows = spark.read.format("crm_pages").schema("Id string, Name string").load(str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [("1", "A, B"), ("2", None), ("3", None)] and rows.rdd.getNumPartitions() == 2
    assert spark.read.format("crm_pages").load(str(tmp_path)).columns == ["Id", "Name", "More"]
    for state in ("Failed", "InProgress"):
        (tmp_path / "job.json").write_text(f'{{"state": "{state}"}}')
        with pytest.raises(Exception, match=state):
            spark.read.format("crm_pages").schema("Id string").load(str(tmp_path)).collect()


def test_marks_go_back(spark, tmp_path):
    marks = incremental.Watermarks(spark, f"file://{tmp_path}/marks")
    marks.put("crm", "contact", "2024-01-02")
    marks.reset("crm", "contact", "2024-01-01")
    assert marks.get("crm", "contact") == "2024-01-01"
    marks.reset("crm", "contact")
    assert marks.get("crm", "contact") is None
