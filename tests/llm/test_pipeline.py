"""The pipeline's stages against plain versions, each on its own input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinfold.llm import exact_dedup, near_dedup, secret_scan
from kinfold.llm.common import BATCH_BYTES, cut, map_columns
from tests.llm.conftest import EDGE
from tests.llm.test_near import plain_components


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output of each stage as rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = cut(stage(spark, docs, sf_dir), name)
        out[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return out


def test_columns_stay(stages):
    for name, (_, _, before, after) in stages.items():
        assert name == "packing" or before == after


def test_language(stages, spark, sf_dir):
    before, after, *_ = stages["language_id"]
    ids = {r["doc_id"] for r in after}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert all(tuple(r) in {tuple(x) for x in before} for r in after)
    assert not good - ids
    assert not [r for r in after if not any(map(str.isalpha, r["text"] or ""))]


def test_exact(stages):
    before, after, *_ = stages["exact_dedup"]
    first: dict = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r)
    assert sorted(after) == sorted(first.values())


def test_near(stages):
    before, after, *_ = stages["near_dedup"]
    least = plain_components([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in least.items() if i == c)


def test_secrets(stages):
    before, after, *_ = stages["secret_scan"]
    assert len(before) == len(after)
    was = {r["doc_id"]: r for r in before}
    for r in after:
        old = was[r["doc_id"]]
        spans = secret_scan.scan_text(old["text"])
        assert (r["text"] == old["text"]) == (not spans)
        assert all(old["text"][a:b] not in r["text"] for a, _, b in spans)


def test_packing(stages):
    before, after, *_ = stages["packing"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after}


def test_run(stages, spark, sf_dir):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(tuple(r) for r in stages["packing"][1])


def test_edges(spark, edge, none):
    for frame in (edge, none):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, ""), name)
        assert (docs.count() > 0) == (frame is edge)


def test_exact_drop_keeps_one_row(spark, edge):
    table = cut(edge, "edge")
    got = Counter(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(table).collect())
    assert got == Counter({i: 1 for i, _ in EDGE if i not in (None, 2, 6, 7)})


def test_clashing_names(spark):
    names = ["row", "__row", "gone", "_gone", "u", "v", "id", "digest", "kept", "first", "n"]
    rows = [(1, "a b c d e f g", *range(11)), (2, "a b c d e f g", *range(11)), (3, None, *range(11)), (4, "z", *[None] * 11)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    want = [rows[0], rows[2], rows[3]]
    assert sorted(map(tuple, exact_dedup.drop_exact_duplicates(frame).collect())) == want
    assert sorted(map(tuple, near_dedup.drop_near_duplicates(frame).collect())) == want
    assert sorted(map(tuple, secret_scan.redact(frame).collect())) == rows


def test_batches_of_texts_are_small(spark):
    """What goes to Python at once follows its bytes: a batch of 10,000 long texts would stand whole in the JVM and in the worker."""

    def sizes(batches):
        for batch in batches:
            yield {"n": [len(batch["text"])], "size": [batch["text"].nbytes]}

    read = spark.range(3000, numPartitions=1).select(F.lpad(F.col("id").cast("string"), 10_000, "x").alias("text"))
    got = map_columns(read, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 3000
    assert max(r["size"] for r in got) < 2 * BATCH_BYTES
