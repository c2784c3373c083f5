"""Toxicity: segments against a plain version, and held-out accuracy."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import queries, toxicity
from tests.llm.conftest import EDGE


def plain_segments(scores):
    """By definition: the best (then shortest, then first) segment, then the same left and right of it."""

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-9 and (best is None or (round(total, 9), i - j) > (round(best[2], 9), best[0] - best[1] + 1)):
                    best = (i, j + 1, total)
        return [] if best is None else [*within(a, best[0]), best, *within(best[1], b)]

    return within(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1.25, 2.5, 0.75]), max_size=30), st.sampled_from([-0.5, -1.0, -0.3125]))
def test_segments(values, drift):
    at = [i for i, v in enumerate(values) if v]
    got = toxicity.maximal_segments(at, [values[i] for i in at], drift)
    want = plain_segments([v or drift for v in values])
    assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in want]
    assert sum(b - a for a, b, _ in got) >= len(at) and all(values[a] and values[b - 1] for a, b, _ in got)


def test_scan_is_linear():
    rng = random.Random(1)
    n = 400_000
    at = sorted(rng.sample(range(2 * n), n))
    toxicity.maximal_segments(at, [rng.random() for _ in at], -0.6)
    toxicity.maximal_segments(at, [1.0 - k / n for k in range(n)], -2.0)


def test_held_out(spark):
    at = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 500 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    toxic = [r for r in got if r["toxic"] and r["quality"]]  # junk has its words mixed up or repeated
    assert sum(r["predicted"] for r in toxic) > 0.97 * len(toxic)
    assert sum(r["predicted"] for r in got if not r["toxic"]) < 0.01 * len(got)
    assert all(r["passages"] for r in toxic if r["predicted"])


def test_held_out_with_junk(spark):
    """All held-out toxic rows, junk too: of the junk (words shuffled, cut or repeated) a part has no toxic word left."""
    at = "/root/testdata/sf0.1"
    got = queries.op4_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("held_out and toxic = 1").collect()
    assert sum(r["predicted"] for r in got) > 0.9 * len(got)
    assert all(r["passages"] for r in got if r["predicted"])


def test_later_passages_count_in_full(spark):
    model = toxicity.Model({"=vile": 3.0, "=filth": 3.0, "=hateful": 3.0}, -0.5)
    model.scale, model.intercept, model.slope = 1e-3, -2.0, 3.0
    text = " ".join(["vile hateful filth " + "word " * 40] * 25)
    (row,) = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[p["begin"] : p["end"]] for p in row["passages"]] == ["vile hateful filth"] * 25
    assert len({p["score"] for p in row["passages"]}) == 1


def test_law_is_fitted_on_all_segments(spark):
    """One clean text with 64 strong segments and 200 weak ones: the weak ones count."""
    text = " ".join(["vile vile" + " word" * 20] * 64 + ["vile" + " word" * 20] * 200)
    model = toxicity.Model({"=vile": 12.0}, -2.0)
    toxicity._calibrate(model, spark.createDataFrame([(0, text)], "label int, text string"), 0.5)
    words = len(text.split())
    assert model.rate == pytest.approx(1 / (12.0 * 64 / 264))  # excess over the median of 12, of all 264
    assert model.scale == pytest.approx(264 / words * math.exp(model.rate * 12.0))


def test_edges(spark, edge, docs, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    got = toxicity.score_toxicity(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3)} == {model.score(0.0)} and model.score(0.0) < 0.5
    assert toxicity.score_toxicity(none, model).count() == 0
    n1, n = labels.filter("toxic = 1").count(), labels.count()
    one = labels.filter("toxic = 0")
    for empty, prior in ((toxicity.fit(none, labels), (n1 + 0.5) / (n + 2)), (toxicity.fit(docs, labels.limit(0)), 0.25), (toxicity.fit(docs, one), 0.5 / (n - n1 + 2))):
        (score,) = {r["score"] for r in toxicity.score_toxicity(edge, empty).collect()}
        assert score == pytest.approx(prior)


def test_passages_are_code_points(spark):
    model = toxicity.Model({"=vile": 6.0}, -0.5)
    model.scale, model.intercept, model.slope = 1e-3, -2.0, 3.0
    text = "😀 é  some  vile vile\tthing and more"
    (row,) = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [text[p["begin"] : p["end"]] for p in row["passages"]] == ["vile vile"] and row["score"] > 0.5


@pytest.mark.parametrize("word", ["", "...", "a", "Don't", "über-großartig", "x1y2"])
def test_terms(word):
    assert all(t[0] in "=^" and t == t.lower() for t in toxicity.terms_of(word))
