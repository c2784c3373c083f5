"""Near-duplicate groups by MinHash: universal hash minima, banding, signature verification, full check, star components.

Texts with equal shingle sets are one node from the start. Nodes that share a band are grouped around the least id of
the band (its leader), never as pairs. Every member is first compared with its leader alone, which joins most of a group
of copies in a number of steps that grows with its members. Only members without such a link are compared with the rest
of the group, block by block. Signatures decide which members can have a partner at
all; only those get their full shingle sets, and only a spanning forest of the confirmed links leaves a task. Components
come from alternating large-star and small-star rounds over these links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded, cut, fresh, held, map_columns

WORDS = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
HASHES = 128
#: A pair at the least similarity may share no band with this probability at most.
MISSED = 1e-5
#: Members of a group that are compared with each other, and those compared with their leader alone, in one piece of work.
BLOCK, STAR_BLOCK = 384, 64
#: Parts over which the members of one leader are spread where they meet its sizes.
SPREAD = 16
CACHE = 200_000

_multipliers = np.array([int.from_bytes(hashlib.blake2b(b"a%d" % i, digest_size=8).digest(), "little") | 1 for i in range(HASHES)], np.uint64)
_offsets = np.array([int.from_bytes(hashlib.blake2b(b"b%d" % i, digest_size=8).digest(), "little") for i in range(HASHES)], np.uint64)


class Banding(NamedTuple):
    """Bands of so many minima each, and the equal minima that a pair needs before its full sets are compared."""

    bands: int
    rows: int
    least_equal: int


def banding(percent: int) -> Banding:
    """The longest bands that a pair of that similarity misses with probability MISSED at most (75: 32 bands of 4, 5e-6).

    A pair of that similarity has fewer equal minima than five standard deviations under the mean with probability 3e-7.
    """
    p = percent / 100
    rows = [r for r in (16, 8, 4, 2, 1) if (1 - p**r) ** (HASHES // r) <= MISSED]
    if not rows or percent > 100:
        raise ValueError("similarities from 9 to 100 percent are supported")
    return Banding(HASHES // rows[0], rows[0], max(1, math.ceil(HASHES * p - 5 * math.sqrt(HASHES * p * (1 - p)))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process; a bounded cache holds the last ones."""
    known = held(("word_hashes",), dict)
    if len(known) > CACHE:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted; with fewer words, of the whole sequence."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z alone is lower-cased, and the white space is ASCII's
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, min(len(h), WORDS), np.uint64)
    for i in range(min(len(h), WORDS)):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, HASHES] of 32-bit minima of universal (multiply-shift) hashes; sets must not be empty."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[begin:end])
        at = np.cumsum([0] + [len(s) for s in sets[begin : end - 1]])
        for k in range(HASHES):
            out[begin:end, k] = np.minimum.reduceat(x * _multipliers[k] + _offsets[k], at) >> np.uint64(32)
        begin = end
    return out


def band_hashes(sigs: np.ndarray, by: Banding) -> np.ndarray:
    """[set, band] of 64-bit hashes of the bands, different from band to band."""
    rows = sigs.reshape(len(sigs), by.bands, by.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(by.bands, dtype=np.uint64) + np.uint64(1), rows.shape[:2])
    for r in range(by.rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return h.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for a, b in bounded(batch["text"]):
                sets = [shingle_set(t) for t in batch["text"][a:b].to_pylist()]
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full))
                yield {
                    "id": batch["id"][a:b],
                    "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                    "sig": [next(sigs).tobytes() if len(s) else None for s in sets],
                }

    return map_columns(docs, run, "id long, n_shingles long, digest binary, sig binary")


def _bands(nodes: DataFrame, by: Banding) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint32).reshape(-1, HASHES)
            yield {"band": band_hashes(sigs, by).ravel(), "node": np.repeat(batch["node"].to_numpy(), by.bands)}

    return map_columns(nodes.select("node", "sig"), run, "band long, node long")


def leader_groups(nodes: DataFrame, by: Banding) -> DataFrame:
    """(leader, node): the distinct members of all bands with two nodes or more, by the least node of the band (itself included)."""
    bands = _bands(nodes, by)
    leaders = bands.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("most")).filter("leader < most").select("band", "leader")
    members = bands.join(leaders, "band").filter("node <> leader").select("leader", "node").distinct()
    return members


def with_sizes(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members with the sizes of their leader; a leader's members are dealt by a part of their hash as well, so none is hot."""
    part = F.pmod(F.xxhash64("node"), F.lit(SPREAD)).alias("part")
    each = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"))
    return members.select("*", part).join(each, ["leader", "part"]).drop("part")


def stars(members: DataFrame, block: int) -> DataFrame:
    """(leader, node, own, i, j): every member beside its leader, in pieces of about so many members (own: i, the leader's: -1)."""
    sizes = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    placed = with_sizes(members, sizes).select("leader", "node", own, F.lit(False).alias("is_leader"))
    leaders = sizes.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.lit(True).alias("is_leader"))
    return placed.unionByName(leaders).select("leader", "node", F.when(F.col("is_leader"), -1).otherwise(F.col("own")).alias("own"), F.col("own").alias("i"), F.lit(-1).alias("j"))


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """(leader, node, own, i, j): the pairs of blocks in which members still have to be compared.

    members: leader, node (leaders included) and joined: whether the node is the leader or linked with it. Those that
    are not are compared with each other and with all others; nodes that are joined need no comparison.
    """
    count = lambda c: F.ceil(F.count_if(c) / F.lit(block)).cast("int")
    sizes = members.groupBy("leader").agg(count(~F.col("joined")).alias("apart"), count(F.col("joined")).alias("rest")).filter("apart > 0")
    both = with_sizes(members, sizes)
    hashed = F.xxhash64("node")
    own = F.when(F.col("joined"), F.col("apart") + F.pmod(hashed, F.greatest("rest", F.lit(1)))).otherwise(F.pmod(hashed, "apart")).cast("int")
    upto = F.when(F.col("joined"), F.col("apart")).otherwise(F.col("apart") + F.col("rest")) - 1
    placed = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), upto)))
    return placed.select("leader", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


KEY = ("leader", "i", "j")


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "node")


def groups_of(batches: Iterator[dict], names: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Whole groups (key, columns as lists) of batches sorted by KEY; a group holds two blocks at most."""
    key, held = None, {n: [] for n in names}
    for batch in batches:
        keys = np.stack([batch[k].to_numpy() for k in KEY], axis=1)
        borders = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        columns = {n: batch[n].to_pylist() for n in names}
        for a, b in zip(borders, borders[1:], strict=False):
            own = tuple(keys[a].tolist())
            if key is not None and own != key:
                yield key, held
                held = {n: [] for n in names}
            key = own
            for n in names:
                held[n] += columns[n][a:b]
    if key is not None:
        yield key, held


def alike(sigs: np.ndarray, own: np.ndarray, i: int, j: int, least_equal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a piece of work that signatures allow: (position, position, equal minima), most alike first."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    equal = np.zeros((len(left), len(right)), np.int16)
    for k in range(sigs.shape[1]):
        equal += sigs[left, k][:, None] == sigs[right, k]
    ok = equal >= least_equal
    if i == j:
        ok &= np.arange(len(left))[:, None] < np.arange(len(right))
    a, b = np.nonzero(ok)
    n = equal[a, b]
    order = np.argsort(-n, kind="stable")
    return left[a[order]], right[b[order]], n[order]


def promising(rows: DataFrame, by: Banding) -> DataFrame:
    """Of (leader, i, j, own, node, sig) the rows whose node has a partner in its piece of work, by the signatures."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        out: list[tuple] = []
        for (leader, i, j), group in groups_of(batches, ["own", "node", "sig"]):
            sigs = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, HASHES)
            a, b, _ = alike(sigs, np.array(group["own"]), i, j, by.least_equal)
            out += [(leader, i, j, group["own"][k], group["node"][k]) for k in np.unique(np.concatenate([a, b])).tolist()]
            if len(out) > 10_000:
                yield dict(zip(("leader", "i", "j", "own", "node"), zip(*out, strict=True), strict=True))
                out = []
        if out:
            yield dict(zip(("leader", "i", "j", "own", "node"), zip(*out, strict=True), strict=True))

    return map_columns(_by_group(rows), run, "leader long, i int, j int, own int, node long").distinct()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as alike as percent says."""
    least, most = sorted((len(a), len(b)))
    if 100 * least < percent * most:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v), u > v: of each piece of work (leader, i, j, own, node, shingles) a spanning forest of the links by full sets."""

    least_equal = banding(percent).least_equal

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        out: list[tuple[int, int]] = []
        for (_, i, j), group in groups_of(batches, ["own", "node", "shingles"]):
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            nodes, root = group["node"], list(range(len(sets)))

            def find(k: int, root=root) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            a, b, _ = alike(signatures(sets), np.array(group["own"]), i, j, least_equal)
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                s, t = find(p), find(q)
                if s != t and linked(sets[p], sets[q], percent):
                    root[max(s, t)] = min(s, t)  # nodes are sorted: the root has the least
            for k in range(len(sets)):
                if (r := find(k)) != k and nodes[r] != nodes[k]:
                    out.append((nodes[k], nodes[r]))
            if len(out) > 10_000:
                yield dict(zip("uv", zip(*out, strict=True), strict=True))
                out = []
        if out:
            yield dict(zip("uv", zip(*out, strict=True), strict=True))

    return map_columns(_by_group(rows), run, "u long, v long").distinct()


def star_components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u that some edge reaches and that is not the least of its component, whose least node v is.

    Large-star joins each node's larger neighbours to its least one, small-star its smaller ones and itself; both by a
    minimum per node that is joined back, so no neighbour list is gathered. The rounds, about as many as the logarithm
    of the nodes, end when nothing changes. Repeated edges and loops add nothing; no edges give no rows.
    """
    now, before = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if not state[0] or tuple(state) == before:
            return now
        before = tuple(state)
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = turned.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = turned.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def _links(read: DataFrame, nodes: DataFrame, placed: DataFrame, by: Banding, percent: int) -> DataFrame:
    """(u, v): the links of pieces of work, confirmed on full sets; only nodes with a partner by the signatures get theirs."""
    found = cut(promising(placed.join(nodes.select("node", "sig"), "node").select(*KEY, "own", "node", "sig"), by), "promising")
    wanted = found.select(F.col("node").alias("id")).distinct()

    def sets(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for a, b in bounded(batch["text"]):
                made = [shingle_set(t) for t in batch["text"][a:b].to_pylist()]
                full = [k for k, s in enumerate(made) if len(s)]
                yield {"node": batch["id"][a:b].take(pa.array(full, pa.int64())), "shingles": [made[k].tobytes() for k in full]}

    full = map_columns(read.join(wanted, "id", "left_semi"), sets, "node long, shingles binary")
    return confirmed(found.join(full, "node").select(*KEY, "own", "node", "shingles"), percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the least id that links reach), kept (id = component_id).

    Texts without words have no shingles and are linked with nothing. Rows with a null id are linked with nothing and
    kept, with a null component. Rows that repeat an id are one document with several texts, linked by what either
    links, and all stay or go together. Ids are integers; an empty table gives no rows; other columns of docs, whatever
    their names, are not read. Percentages that the bands can't serve (under 9) are refused.
    """
    by = banding(percent)
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(_signed(read), "signed")
    some = signed.filter("digest is not null and id is not null")
    nodes = cut(some.groupBy("digest").agg(F.min("id").alias("node"), F.first("sig").alias("sig")), "nodes")
    members = cut(leader_groups(nodes, by), "groups")
    links = cut(_links(read, nodes, stars(members, min(block, STAR_BLOCK)), by, percent), "links")
    with_leader = links.select(F.col("u").alias("node"), F.col("v").alias("leader"), F.lit(True).alias("joined"))
    judged = members.join(with_leader, ["leader", "node"], "left").select("leader", "node", F.coalesce("joined", F.lit(False)).alias("joined"))
    heads = members.select("leader", F.col("leader").alias("node"), F.lit(True).alias("joined")).distinct()
    more = _links(read, nodes, in_blocks(cut(judged.unionByName(heads), "judged"), block), by, percent)
    found = star_components(links.unionByName(more))
    of = nodes.select("digest", "node").join(found.select(F.col("u").alias("node"), F.col("v").alias("to")), "node", "left")
    of = of.select("digest", F.coalesce("to", "node").alias("component_id"))
    out = some.select("id", "n_shingles", "digest").join(of, "digest").select("id", "n_shingles", "component_id")
    rest = signed.filter("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    kind = docs.schema[id_col].dataType
    return out.unionByName(rest).select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, whose document is the least of its group; rows with a null id stay.

    Null and empty texts are in no group and stay, as do all rows that repeat an id that stays.
    """
    gone = fresh(docs, "gone")
    judged = near_duplicates(docs, id_col, text_col, percent).filter(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(judged, F.col(id_col) == F.col(gone), "left_anti")
