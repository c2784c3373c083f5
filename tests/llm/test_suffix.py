"""Removal of repeated byte strings against a plain version."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import queries, suffix_dedup
from tests.llm.conftest import EDGE


def plain_strip(rows, length=100):
    """rows: (id, text), ids in order of place. Gives {id: (bytes, ranges, kept)} with each id's texts in turn."""
    seen: dict[bytes, tuple[int, int]] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            seen[w] = min(seen.get(w, (i, p)), (i, p))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] < (i, p):
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        ranges = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((i, len(b), ranges, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


def got_rows(frame, length=100):
    return [(r["doc_id"], r["n_bytes"], [(s["begin"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.strip_repeats(frame, length=length).collect()]


def place(row):
    return (row[0] is not None, row[0] or 0)


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    monkeypatch.setattr(suffix_dedup, "BUFFERED", 40)
    monkeypatch.setattr(suffix_dedup, "HELD", 3)


def test_documents(spark, docs, texts):
    assert sorted(got_rows(docs)) == sorted(plain_strip(sorted(texts.items())))


def test_edges(edge, none):
    want = plain_strip([(-(1 << 63) if i is None else i, t) for i, t in EDGE])
    got = [(-(1 << 63) if r[0] is None else r[0], *r[1:]) for r in got_rows(edge)]
    assert sorted(got) == sorted(want)
    assert got_rows(none) == []


def cases(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(20, 400))) for _ in range(6)]
    made = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            parts.append(rng.choice([b, b[a:], b[:a], rng.choice("xyzé") * rng.randrange(1, 150), b[::-1]]))
        made.append((i, "".join(parts)))
    return made


@pytest.mark.parametrize("length", [8, 20, 100])
def test_mixed_passages(spark, length):
    rows = cases(length)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(got_rows(frame, length)) == sorted(plain_strip(rows, length))


def local(rows, length, parts=3):
    """The same work in one process: runs, splitters and merge."""
    s = suffix_dedup.Shape(length)
    import pyarrow as pa

    half = len(rows) // 2
    grams = sorted({t.encode()[k : k + s.gram].ljust(s.gram, b" ") for _, t in rows for k in (0, 5)} - {b""})
    splitters = np.array(grams[:: max(1, len(grams) // parts)][1:parts], f"S{s.gram}")
    blobs: dict[int, list] = {}
    found: dict[int, list] = {i: [] for i, _ in rows}
    for some in (rows[:half], rows[half:]):
        batch = {"id": pa.array([i for i, _ in some], pa.int64()), "key": pa.array([0] * len(some), pa.int64()), "text": pa.array([t for _, t in some], pa.string())}
        for out in suffix_dedup.sorted_runs(iter([batch]), s, splitters, parts):
            for part, ident, data in zip(out["part"], out["id"], out["data"], strict=True):
                if ident is None:
                    blobs.setdefault(part, []).append(data)
                else:
                    found[ident].append(data)
    for own in blobs.values():
        spans = suffix_dedup.Spans()
        for _ in suffix_dedup.merge_families(own, s, spans):
            for ident, _, data in spans.rows():
                found[ident].append(data)
    out = {}
    for i, packed in found.items():
        got = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in packed]) if packed else np.zeros((0, 2), np.int64)
        out[i] = [tuple(x) for x in suffix_dedup.joined(*got[np.argsort(got[:, 0], kind="stable")].T).tolist()]
    return out


@settings(max_examples=60, deadline=None, suppress_health_check=[])
@given(st.integers(0, 10**9), st.sampled_from([8, 9, 16, 40, 100]))
def test_any_passages(seed, length):
    rows = cases(seed)
    assert local(rows, length) == {i: r for i, _, r, _ in plain_strip(rows, length)}


@pytest.mark.parametrize("seed", range(8))
def test_spills_and_slices(small_blocks, seed):
    rows = cases(1000 + seed)
    for length in (16, 100):
        assert local(rows, length) == {i: r for i, _, r, _ in plain_strip(rows, length)}


def test_query(spark, sf_dir, texts):
    want = {i: (n, sum(b - a for a, b in r), len(r), hashlib.sha256(kept).hexdigest()) for i, n, r, kept in plain_strip(sorted(texts.items()))}
    got = queries.op2_suffix_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want and len(got) == len(want)
