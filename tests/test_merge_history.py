"""Merges, rings of them, and their undo in any order against a plain history."""

import random

import pytest

from kinfold.operators import merge

FIELDS = "person_id long, first_name string, last_name string, email string"
PAIRS = "suggestion_id long, primary_id long, candidate_id long"
NAMES = ("first_name", "last_name", "email")


@pytest.mark.parametrize("size", [2, 3, 5])
def test_rings_keep_their_least_person(spark, size):
    ring = [(k + 1, 10 + (k + 1) % size, 10 + k) for k in range(size)]
    tail = [(50, 12 if size > 2 else 11, 3), (51, 3, 2), (60, 70, 71), (61, 71, 72), (62, 80, 80), (63, None, 4)]
    got = {(r["candidate_id"], r["primary_id"]) for r in merge.resolved_pairs(spark.createDataFrame(ring + tail, PAIRS)).collect()}
    assert got == {(10 + k, 10) for k in range(1, size)} | {(3, 10), (2, 10), (71, 70), (72, 70)}


def plain(own, merges):
    """One merge after the other; a survivor takes what it lacks."""
    people = {i: list(v) for i, v in own.items()}
    for _, primary, candidate in sorted(merges):
        gone = people.pop(candidate)
        people[primary] = [a or b for a, b in zip(people[primary], gone, strict=True)]
    return people


def blankless(rows):
    return {r[0]: [x or None for x in r[1:]] for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_undo_in_any_order_is_never_having_merged(spark, seed):
    rng = random.Random(seed)
    own = {i: [rng.choice([None, " ", f"f{i}"]), rng.choice([None, f"l{i}"]), rng.choice([None, f"e{i}"])] for i in range(1, 13)}
    own = {i: [x if x and x.strip() else None for x in v] for i, v in own.items()}
    alive, merges, people, log = list(own), [], spark.createDataFrame([(i, *v) for i, v in own.items()], FIELDS), None
    for batch in range(3):  # batch after batch, so that survivors are merged into others later
        rows, used = [], set()
        for _ in range(3):
            primary, candidate = rng.sample([a for a in alive if a not in used], 2)
            used |= {primary, candidate}
            rows.append((len(merges) + len(rows) + 1, primary, candidate))
            alive.remove(candidate)
        merges += rows
        people, new = merge.merge_people(people, spark.createDataFrame(rows, PAIRS))
        people, new = merge.cut(people, "people"), merge.cut(new, "log")
        log = new if log is None else log.unionByName(new)
    assert blankless(map(tuple, people.select("person_id", *NAMES).collect())) == plain(own, merges)
    left = list(merges)
    for undone in (rng.sample(merges, 2), None):
        gone = undone or left
        left = [m for m in left if m not in gone]
        people, log = merge.undo_by_replay(people, log, spark.createDataFrame([(m[0],) for m in gone], "suggestion_id long"))
        people, log = merge.cut(people, "people"), merge.cut(log, "log")
        try:
            want = plain(own, left)
        except KeyError:  # what was merged into a survivor that is gone again
            continue
        assert blankless(map(tuple, people.select("person_id", *NAMES).collect())) == want
    assert not left and blankless(map(tuple, people.select("person_id", *NAMES).collect())) == own


def test_undo_keeps_what_was_changed_by_hand(spark):
    people = spark.createDataFrame([(1, "Ann", None, None), (2, None, "Lee", "b@x.org"), (3, None, "Li", None), (9, "Zoe", None, None)], FIELDS)
    after, log = merge.merge_people(people, spark.createDataFrame([(1, 1, 2), (2, 1, 3)], PAIRS))
    edited = after.replace({"b@x.org": "new@x.org"}, subset=["email"])
    back, rest = merge.undo_by_replay(edited, log, spark.createDataFrame([(1,), (77,)], "suggestion_id long"))
    assert {tuple(r) for r in back.collect()} == {(1, "Ann", "Li", "new@x.org"), (2, None, "Lee", "b@x.org"), (9, "Zoe", None, None)}
    assert {(r["suggestion_id"], r["undone"]) for r in rest.collect()} == {(1, True), (2, False)}
