"""Merkle manifest, SimHash groups and conversation tries against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm import merkle, prefix_trie, queries, simhash
from kinfold.llm.common import cut, remainder
from kinfold.llm.near_dedup import star_components
from tests.llm.conftest import EDGE


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tiers(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(found, i, fanout):
    out = []
    for tier in found[:-1]:
        run = i - i % fanout
        out.append(("".join(tier[run:i]), "".join(tier[i + 1 : run + fanout])))
        i //= fanout
    return out


def fold(h, proof):
    for before, after in proof:
        h = digest(before, h, after)
    return h


def plain_manifest(rows, fanout=3):
    """Counter of (id, leaf, subroot, root, proof)."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf([r[c] for c in merkle.FIELDS])), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tiers([k[2] for k, _ in sorted(by[s], key=lambda x: x[0])], fanout) for s in sources}
    top = tiers([trees[s][-1][0] for s in sources], fanout)
    out = Counter()
    for k, s in enumerate(sources):
        for i, (key, r) in enumerate(sorted(by[s], key=lambda x: x[0])):
            out[r["doc_id"], key[2], trees[s][-1][0], top[-1][0], tuple(steps(trees[s], i, fanout) + steps(top, k, fanout))] += 1
    return out


def manifest_rows(found):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(map(tuple, r["proof"]))) for r in found.collect())


@pytest.mark.parametrize(("fanout", "bucket", "width"), [(3, 512, 2187), (3, 2, 9), (2, 5, 4), (7, 1, 7)])
def test_manifest(spark, docs, fanout, bucket, width):
    found = merkle.manifest(docs, fanout=fanout, bucket_rows=bucket, width=width)
    assert manifest_rows(found) == plain_manifest(docs.collect(), fanout)


def test_manifest_edges(edge, none):
    rows = edge.unionByName(edge.filter("doc_id = 7 or doc_id is null")).unionByName(edge.withColumn("doc_id", -F.col("doc_id") * 10**15))
    want = plain_manifest(rows.collect())
    for bucket, width in ((1, 3), (512, 2187)):
        found = merkle.manifest(rows, bucket_rows=bucket, width=width)
        assert manifest_rows(found) == want
    assert merkle.manifest(none).count() == 0


def test_manifest_of_one_hot_id(spark):
    """A third of all rows have one id, with texts that repeat: buckets go on to the digits of leaves and row numbers."""
    rows = [(5 if k % 3 == 0 else k, f"t{k % 7}", "en", "a", k % 2) for k in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert manifest_rows(merkle.manifest(frame, bucket_rows=4, width=27)) == plain_manifest(frame.collect())
    one = merkle.manifest(frame.limit(1)).head()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []


def test_manifest_query(spark, docs, sf_dir):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_merkle_manifest(spark, sf_dir).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    want = {}
    for (i, leaf, sub, root, proof), _ in plain_manifest(rows.values()).items():
        r = rows[i].asDict()
        if zlib.crc32(str(i).encode()) % 2 == 0 and r["text"] is not None:
            r["text"] = r["text"].replace("\n", "")
        end = fold(plain_leaf([r[c] for c in merkle.FIELDS]), proof)
        want[i] = (leaf, sub, root, digest(*[x for s in proof for x in s]), end, end == root)
    assert got == want
    assert {v[-1] for v in got.values()} == {True, False}


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, most):
    """For each value the least position that links reach."""
    v, root = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= most) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def test_fingerprints(texts):
    assert {i: simhash.fingerprint(t) for i, t in texts.items()} == {i: plain_fingerprint(t) for i, t in texts.items()}
    for _, t in EDGE:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    long = " ".join(f"w{k % 977}" for k in range(40_000))  # several blocks of shingles
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def clusters(seed):
    rng = random.Random(seed)
    values = {0, 2**64 - 1, 1, 3, 7, 15, 1 << 63}
    for size in [1, 2, 5, 120] * 6:
        center = rng.getrandbits(64)
        for _ in range(size):
            values.add(center ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))}))
    base = rng.getrandbits(64)
    values |= {base ^ rng.getrandbits(11) for _ in range(300)}  # one node of the trie holds them all, far down
    values |= {base ^ rng.getrandbits(11) << 32 for _ in range(300)}
    return sorted(values)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
def test_forest_joins_what_links_join(most):
    for seed in range(3):
        values = clusters(seed)
        a = np.array(values, np.uint64)
        turned = np.sort(a << np.uint64(32) | a >> np.uint64(32))
        root = np.arange(len(a))
        for side, back in ((a, a), (turned, turned << np.uint64(32) | turned >> np.uint64(32))):
            where = dict(zip(side.tolist(), np.searchsorted(a, back).tolist(), strict=True))
            u, v = simhash.forest(side, side, True, 0, 0, most)
            root = simhash.joined(root, np.array([where[x] for x in u.tolist()], int), np.array([where[x] for x in v.tolist()], int))
        assert root.tolist() == plain_components(values, most)


@pytest.mark.parametrize(("most", "leaf"), [(3, 8), (3, 300), (4, 100_000)])
def test_links(spark, most, leaf):
    values = clusters(7)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "v long").repartition(3)
    root = {r["u"]: r["v"] for r in star_components(simhash.links(frame, most, leaf)).collect()}
    groups, plain = defaultdict(set), defaultdict(set)
    for v, r in zip(signed, plain_components(values, most), strict=True):
        groups[root.get(v, v)].add(v)
        plain[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def plain_simhash(rows):
    """(id, fingerprint, component) of each row, null ids last."""
    marks = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(marks, 3)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return Counter((i, f, least.get(r)) for (i, _), f, r in zip(rows, marks, roots, strict=True))


def test_simhash(spark, sf_dir, docs, texts, edge, none):
    got = Counter((r[0], int(r[1], 16), r[2]) for r in queries.op12_simhash_dedup(spark, sf_dir).collect())
    assert got == plain_simhash(sorted(texts.items()))
    got = Counter((r[0], r[1] % 2**64, r[2]) for r in simhash.simhash_groups(edge, leaf=2).collect())
    assert got == plain_simhash(EDGE)
    assert simhash.simhash_groups(none).count() == 0
    near = [(1, "a b c d e f g h " * 40), (2, "a b c d e f g h " * 41), (3, "z y x w"), (None, "q r s")]
    frame = spark.createDataFrame(near, "doc_id int, text string")
    assert Counter((r[0], r[1] % 2**64, r[2]) for r in simhash.simhash_groups(frame).collect()) == plain_simhash(near)


def rebuild(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append(((turn is not None, turn or 0, tie), (role, text)))
    by = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in by.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in by}
    return {c: by.get(c - c % 100, [])[: heads[c]] + v[heads[c] :] for c, v in by.items()}


def plain_trie(sequences):
    nodes = defaultdict(list)
    for c, s in sequences:
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append((c, len(s)))
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        own = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += k not in kids
    least = {k: min(m)[0] for k, m in nodes.items()}
    ends = {k: digest(",".join(map(str, sorted(c for c, n in m if n == len(k))))) for k, m in nodes.items()}
    return Counter((least[k], len(k), least[k[:-1]] if k else None, len(m), kids[k], leaves[k], saved[k], ends[k]) for k, m in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.op13_prefix_trie(spark, sf_dir)
    assert found.columns == COLUMNS
    assert Counter(tuple(r) for r in found.collect()) == plain_trie(rebuild(rows).items())


TURNS = "conv_id long, turn long, role string, text string, id string, keys int, node string"


@pytest.mark.parametrize(("run", "ranged", "joined"), [(300, 900, 2), (150, 400, 3), (1 << 20, 8 << 20, 32)])
def test_trie_edges(spark, run, ranged, joined):
    """Null turns, roles, texts and ids, ties, repeated rows, a hot conversation, turnless ones, and names that clash."""
    rng = random.Random(3)
    rows = [(c, None if t == 1 else t, None if rng.random() < 0.2 else "user", rng.choice([None, "", "😀é", "a", "bb" * 9])) for c in range(90, 230) for t in range(rng.randrange(1, 7))]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 400) for t in range(7)] + [(400, t // 2, "x", str(t % 5)) for t in range(120)]
    rows += [(400, 3, "x", "1")] * 3 + [(None, 1, "user", "lost"), (512, 0, None, None)]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS).repartition(5)
    own = prefix_trie.sequences_of(frame)
    built = cut(prefix_trie.rebuilt(own, F.col("id") - F.col("id") % 100, remainder("id", 6).cast("int"), 5), "built")
    found = prefix_trie.prefix_trie(built, run, ranged, joined).select(*COLUMNS)
    assert Counter(tuple(r) for r in found.collect()) == plain_trie(rebuild(rows).items())


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.sequences_of(empty)).count() == 0


KEYS = st.lists(st.sampled_from([bytes([k]) * prefix_trie.KEY for k in range(3)]), max_size=6).map(b"".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(KEYS, max_size=8), max_size=6))
def test_loser_tree(runs):
    tree = prefix_trie.LoserTree([prefix_trie.Run([(k, n) for k in keys]) for n, keys in enumerate(runs)])
    before, out = b"", []
    for keys, lcp, rest in tree:
        assert lcp == prefix_trie.shared(before, keys, 0)
        out.append((keys, rest[0]))
        before = keys
    assert sorted(out) == sorted((k, n) for n, keys in enumerate(runs) for k in keys)
    assert [k for k, _ in out] == sorted(k for k, _ in out)


def test_loser_tree_looks_at_no_shared_turn_again():
    deep = b"".join(bytes([k]) * prefix_trie.KEY for k in range(200))
    runs = [prefix_trie.Run([(deep + bytes([r, k]) * 8, k) for k in range(100)]) for r in range(4)]
    tree = prefix_trie.LoserTree(runs)
    assert len(list(tree)) == 400
    assert tree.compared < 4 * 200 + 400 * 6
