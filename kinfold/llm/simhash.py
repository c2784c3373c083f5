"""Near-duplicate groups by SimHash fingerprints: a binary trie of them is joined with itself.

Pairs of trie nodes are followed together from the root; each step adds the bits in which their children differ, and a
pair is given up once that exceeds what may differ. Of k differing bits one half of a fingerprint holds k // 2 at most,
so the trie is joined in two orders of the halves, each with that smaller budget for the half that comes first. Spark
follows pairs of large nodes as tables, four bits a round; pairs of small nodes, whole with their fingerprints, are
followed to the end inside tasks, where node pairs that lie in one component already are given up too. Only a spanning
forest of the links leaves a task. Documents with one fingerprint are one entry of the trie from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded, cut, map_columns
from kinfold.llm.near_dedup import star_components

WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
MOST = 3
#: Fingerprints of two nodes that a task follows to the end, bits that a round of tables goes down, and the last depth of tables.
LEAF, STEP, DEEPEST = 4096, 4, 60
#: Products of ranges that are compared directly, and direct comparisons at a time.
DIRECT, AT_ONCE = 64, 1 << 18
#: Shingles that are counted at a time, and parts over which a node's fingerprints are spread when they meet the wanted nodes.
SHINGLES, SPREAD = 1 << 14, 16
_PLACES = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64 bits of a text: each is 1 if it is set in over half the hashes of its shingles, repeats included."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z alone is lower-cased, and the white space is ASCII's
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - WORDS + 1)
    last = ends[WORDS - 1 :] if len(words) >= WORDS else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES):
        spans = zip(starts[a : min(n, a + SHINGLES)].tolist(), last[a : a + SHINGLES].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64)
        each = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACES  # how often each byte value comes in each place
        counts += (np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, v) for (id, text): the fingerprints as signed integers."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for a, b in bounded(batch["text"]):
                found = np.array([fingerprint(t) for t in batch["text"][a:b].to_pylist()], np.uint64)
                yield {"id": batch["id"][a:b], "v": found.view(np.int64)}

    return map_columns(docs, run, "id long, v long")


def budget(depth: int, most: int) -> int:
    """Bits that may differ down to a depth: in the half that comes first, half of all."""
    return most // 2 if depth <= 32 else most


def _split(values: np.ndarray, low: np.ndarray, bit: int) -> np.ndarray:
    """Where the ranges that begin at low, each of one prefix down to that bit, have the bit set for the first time."""
    begin = values[low] >> np.uint64(bit + 1) << np.uint64(1) | np.uint64(1)
    return np.searchsorted(values, begin << np.uint64(bit))


def close_pairs(a: np.ndarray, b: np.ndarray, depth: int, err: int, most: int, stop: int, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of fingerprints that differ in `stop` bits at most; a and b are sorted nodes of one depth.

    err: the bits in which the nodes differ already. root: the components of a's and then b's fingerprints so far; ranges
    that all lie in one are given up. If a is b, each pair comes once. With more than most // 2 bits in the first half,
    pairs are left to the other order.
    """
    same = a is b
    change = [np.concatenate([[0], np.cumsum(r[1:] != r[:-1])]) for r in (root[: len(a)], root[len(a) :] if not same else root)]
    front = [np.array([x]) for x in (0, len(a), 0, len(b), err)]
    at_b = 0 if same else len(a)
    for d in range(depth, 65):
        la, ha, lb, hb, e = front
        one = (change[0][la] == change[0][ha - 1]) & (change[1][lb] == change[1][hb - 1]) & (root[la] == root[at_b + lb])
        if same:
            one &= (la != lb) | (ha - la == 1) | (change[0][la] == change[0][ha - 1])
        front = [x[~one] for x in front]
        la, ha, lb, hb, e = front
        small = ((ha - la) * (hb - lb) <= DIRECT) | (d == 64)
        yield from _direct(a, b, [x[small] for x in front], stop, same)
        la, ha, lb, hb, e = (x[~small] for x in front)
        if not len(la):
            return
        ma, mb = _split(a, la, 63 - d), _split(b, lb, 63 - d)
        cross = np.flatnonzero((la != lb) | (not same))  # of a node with itself, one of the two crossings is enough
        front = [
            np.concatenate(x)
            for x in (
                (la, ma, la, ma[cross]),
                (ma, ha, ma, ha[cross]),
                (lb, mb, mb, lb[cross]),
                (mb, hb, hb, mb[cross]),
                (e, e, e + 1, e[cross] + 1),
            )
        ]
        ok = (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= min(stop, budget(d + 1, most)))
        front = [x[ok] for x in front]


def _direct(a: np.ndarray, b: np.ndarray, front: list[np.ndarray], stop: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    la, ha, lb, hb, _ = front
    sizes = (ha - la) * (hb - lb)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + AT_ONCE, "right")))
        k = np.repeat(np.arange(begin, upto), sizes[begin:upto])
        inner = np.arange(len(k)) - np.repeat(ends[begin:upto] - sizes[begin:upto] - (ends[begin - 1] if begin else 0), sizes[begin:upto])
        i, j = la[k] + inner // (hb - lb)[k], lb[k] + inner % (hb - lb)[k]
        ok = np.bitwise_count(a[i] ^ b[j]) <= stop
        if same:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]
        begin = upto


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The components after these links, each by its least position."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        if (low == high).all():
            return root
        root = root.copy()
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def forest(a: np.ndarray, b: np.ndarray, same: bool, depth: int, err: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): links that span the components of two sorted nodes' fingerprints."""
    b = a if same else b
    values = a if same else np.concatenate([a, b])
    root = np.arange(len(values))
    for stop in sorted({min(1, most), most}):  # close links first: what they join is given up afterwards
        for i, j in close_pairs(a, b, depth, err, most, stop, root.copy()):
            root = joined(root, i, j + (0 if same else len(a)))
    moved = np.flatnonzero(root != np.arange(len(root)))
    return values[moved], values[root[moved]]


def _prefix(v: Column, depth: int) -> Column:
    return F.shiftrightunsigned(v, 64 - depth) if depth else F.lit(0).cast("long")


def node_pairs(entries: DataFrame, most: int, leaf: int) -> DataFrame:
    """(o, depth, a, b, err) for (o, v): pairs of nodes that may hold links, small enough for a task; written tables."""
    nodes = entries.groupBy("o").agg(F.count(F.lit(1)).alias("n"))
    pairs = nodes.select("o", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("err"), (2 * F.col("n")).alias("n"))
    masks = [m for m in range(1 << STEP) if m.bit_count() <= most]
    found, depth = None, 0
    while True:
        pairs = cut(pairs, "pairs")
        done = F.col("n") <= leaf if depth < DEEPEST else F.lit(True)
        small = pairs.filter(done).select("o", F.lit(depth).alias("depth"), "a", "b", "err")
        found = small if found is None else found.unionByName(small)
        pairs = pairs.filter(~done)
        if pairs.isEmpty():
            return found
        depth += STEP
        nodes = cut(entries.groupBy("o", _prefix(F.col("v"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n")), "nodes")
        left = nodes.select("o", F.shiftrightunsigned("node", STEP).alias("a"), F.col("node").alias("a2"), F.col("n").alias("n_a"))
        right = nodes.select("o", F.col("node").alias("b2"), F.col("n").alias("n_b"))
        ways = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(m.bit_count()).alias("bits")) for m in masks])
        spread = pairs.select("o", "a", "b", "err", F.explode(ways).alias("way")).filter(F.col("err") + F.col("way.bits") <= budget(depth, most))
        turned = F.shiftleft("b", STEP).bitwiseOR(F.col("a2").bitwiseAND((1 << STEP) - 1).bitwiseXOR(F.col("way.mask")))
        below = spread.join(left, ["o", "a"]).select("o", "a", "b", "a2", "n_a", turned.alias("b2"), (F.col("err") + F.col("way.bits")).alias("err"))
        below = below.filter((F.col("a") != F.col("b")) | (F.col("a2") <= F.col("b2"))).join(right, ["o", "b2"])
        pairs = below.select("o", F.col("a2").alias("a"), F.col("b2").alias("b"), "err", (F.col("n_a") + F.col("n_b")).alias("n"))


def links(values: DataFrame, most: int = MOST, leaf: int = LEAF) -> DataFrame:
    """(u, v) that span the components of the distinct fingerprints `v` under links of `most` differing bits."""
    v = F.col("v")
    turned = F.shiftleft(v, 32).bitwiseOR(F.shiftrightunsigned(v, 32))
    entries = cut(values.select(F.explode(F.array(F.struct(F.lit(0).alias("o"), v.alias("v")), F.struct(F.lit(1).alias("o"), turned.alias("v")))).alias("e")).select("e.*"), "entries")
    pieces = cut(node_pairs(entries, most, leaf), "pieces")
    depths = [r[0] for r in pieces.select("depth").distinct().collect()]  # DEEPEST / STEP + 1 at most
    if not depths:
        return values.select(v.alias("u"), v).limit(0)
    wanted = pieces.select("o", "depth", F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    placed = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(v, d).alias("node")) for d in sorted(depths)])
    rows = entries.select("o", "v", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int").alias("part"), F.explode(placed).alias("p")).select("o", "v", "part", "p.*")
    held = rows.join(wanted, ["o", "depth", "node", "part"], "left_semi").groupBy("o", "depth", "node").agg(F.collect_list("v").alias("vs"))
    held = cut(held, "held")
    both = pieces.join(held.select("o", "depth", F.col("node").alias("a"), F.col("vs").alias("left")), ["o", "depth", "a"])
    second = held.select("o", "depth", F.col("node").alias("b"), F.col("vs").alias("right"))
    both = both.join(second, ["o", "depth", "b"]).select("o", "depth", F.col("a").alias("na"), F.col("b").alias("nb"), "err", "left", "right")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = []
            ints = [batch[c].to_pylist() for c in ("o", "depth", "na", "nb", "err")]
            for k, (o, depth, a, b, err) in enumerate(zip(*ints, strict=True)):
                left, right = (np.sort(batch[c][k].values.to_numpy().view(np.uint64)) for c in ("left", "right"))
                pair = forest(left, right, a == b, depth, err, most)
                out.append(pair if not o else tuple(x << np.uint64(32) | x >> np.uint64(32) for x in pair))
            u, w = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
            yield {"u": u, "v": w}

    return map_columns(both, run, "u long, v long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: id, fingerprint (64 bits as a signed integer), component_id (the least id that links reach).

    Fingerprints are linked when they differ in `most` bits or fewer. Null and empty texts and those without words have
    fingerprint zero and are linked like any other; texts of any length count whole. A null id counts last: its
    component is that of the others, or null. Rows that repeat an id are taken each by its own text. Ids are integers; an
    empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = cut(fingerprints(read), "fingerprints")
    values = cut(marked.groupBy("v").agg(F.min("id").alias("least")), "values")
    found = star_components(links(values.select("v"), most, leaf)).select(F.col("u").alias("v"), F.col("v").alias("root"))
    rooted = values.join(found, "v", "left").select("v", "least", F.coalesce("root", "v").alias("root"))
    rooted = cut(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("v", "component_id")
    kind = docs.schema[id_col].dataType
    return marked.join(of, "v").select(F.col("id").cast(kind).alias(id_col), F.col("v").alias("fingerprint"), F.col("component_id").cast(kind).alias("component_id"))
