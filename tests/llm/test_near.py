"""Near-duplicate groups against a plain all-pairs version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kinfold.llm import near_dedup, queries
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain_components(rows, percent=75):
    """{id: (set size, least id reachable)} by all pairs."""
    sets = {i: plain_set(t) for i, t in rows}
    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in by_shingle[x] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def checked(frame, rows, **kw):
    got = near_dedup.near_duplicates(frame, **kw).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, kw.get("percent", 75))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_documents(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    got = queries.op5_minhash_dedup(spark, at).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows)
    assert len(got) == len(rows) and any(not r["kept"] for r in got)


@pytest.mark.parametrize("block", [7, 384])
def test_large_group_of_mixed_likeness(spark, block):
    """Copies with more and less edits: links between copies that the first one is not linked with must be found."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(160)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    checked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, block=block)


@pytest.mark.parametrize("percent", [30, 50, 75, 90])
def test_any_percentage(spark, percent):
    rng = random.Random(percent)
    rows = []
    for i in range(60):
        base = [f"b{i}w{k}" for k in range(100)]
        rows.append((2 * i, " ".join(base)))
        rows.append((2 * i + 1, " ".join(base[rng.randrange(60) :])))
    checked(spark.createDataFrame(rows, "doc_id long, text string"), rows, percent=percent)


def test_percentages_that_bands_cannot_serve():
    assert near_dedup.banding(75) == (32, 4, 72)
    with pytest.raises(ValueError, match="percent"):
        near_dedup.banding(5)


def test_edges(spark, edge, none):
    got = near_dedup.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[6] == by[7] == 5 and by[1] == 1 and by[2] == 2 and by[3] == 3
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.drop_near_duplicates(edge)
    assert left.columns == edge.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _ in EDGE if i not in (6, 7))


def test_signatures_estimate():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(x[:3000]), np.unique(x[1000:])
    s = near_dedup.signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.15
    assert (near_dedup.signatures([a])[0] == s[0]).all()


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_paths(spark, n):
    edges = [(k * 100 + i, k * 100 + i + 1) for k in range(3) for i in range(n)]
    random.Random(1).shuffle(edges)
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r["u"]: r["v"] for r in near_dedup.star_components(frame).collect()}
    assert got == {k * 100 + i: k * 100 for k in range(3) for i in range(1, n + 1)}
