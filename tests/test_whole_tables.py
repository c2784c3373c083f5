"""Queries that do the whole job beside registered ones whose SQL fixes a part of it."""


from collections import Counter

from kinfold import queries
from kinfold.operators import match


def at_sf(spark, name, at="/root/testdata/sf0.01"):
    return queries.queries()[name](spark, at)


def test_contact_overlap_whole(spark):
    """Every contact with another 130 ids later is compared, not only the first rows."""
    got = at_sf(spark, "contact_overlap_whole").collect()
    ids = {r["c_custkey"] for r in spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select("c_custkey").collect()}
    assert sorted((r["row_a"], r["row_b"]) for r in got) == sorted((i, i + 130) for i in ids if i + 130 in ids)


def test_scans_compare_all_brands(spark):
    """As many pairs in the blocks, whatever the brand, as there are with the same last name and initial."""
    people = [tuple(r["p_name"].lower().split()) for r in spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_name").collect()]
    blocks = Counter((last, first[0]) for first, last in people)
    got = {(r["last"], r["initial"]): r["n_pairs"] for r in at_sf(spark, "block_name_initial_counts").collect()}
    assert got == {k: n * (n - 1) // 2 for k, n in blocks.items() if n > 1}
    bands = {r["match_type"]: r["n"] for r in at_sf(spark, "weighted_score_band_whole").collect()}
    same = sum(n * (n - 1) // 2 for n in Counter(people).values())  # an exact name alone scores 0.90: review or high
    assert bands["high"] + bands["review"] >= same > sum(r["n"] for r in at_sf(spark, "weighted_score_band").collect())
    classes = Counter()
    for r in at_sf(spark, "duplicate_scan_classes").collect():
        classes[r["match_type"]] += r["n"]
    assert classes == {k: n for k, n in bands.items() if k != "low"}


def test_stored_plus_addresses_match(spark):
    long = "a" * 70
    incoming = [(1, "box5@org.test"), (2, "Box5+y@Org.test"), (3, "box6@org.test"), (4, "box5@other.test"), (5, f"{long}@org.test"), (6, "@org.test"), (7, "a_b@org.test"), (8, "x@a@b")]
    stored = [(10, "box5+x@org.test"), (11, "box7@org.test"), (12, f"{long}+x@org.test"), (13, f"{long[:68]}@org.test"), (14, "acb@org.test"), (15, "xy@a@b"), (16, "xy@b")]
    left = spark.createDataFrame(incoming, "row_id long, email string").selectExpr("*", "cast(null as string) phone")
    right = spark.createDataFrame(stored, "person_id long, email string").selectExpr("*", "cast(null as string) phone")
    got = {r["row_id"]: (r["outcome"], r["matched_id"]) for r in match.match_by_contact(left, right, prefix=True).collect()}
    none = ("none", None)
    assert got == {1: ("email", 10), 2: ("email", 10), 3: none, 4: none, 5: ("email", 12), 6: none, 7: none, 8: ("email", 15)}


def test_registered_prefix_match(spark):
    """box1 also begins box10 and so on, so that other outcomes come out than by equal addresses alone."""
    plain, whole = (set(map(tuple, at_sf(spark, n).collect())) for n in ("deterministic_match_outcome", "deterministic_match_with_prefix"))
    assert len(plain) == len(whole) and plain != whole
