"""Prefix trie of conversations by an external mergesort that knows common prefixes.

A conversation is the sequence of the digests of its turns; equal sequences are one entry with a count. Spark deals the
sequences out by ranges. A task sorts bounded runs of its range, front-coded with the turns that each sequence shares with
the one before it, and merges them by a loser tree that compares no shared turn again. The merged stream has with each
sequence what it shares with its predecessor, so a stack of the nodes on the open path suffices: a node is finished when
the stream leaves it. Nodes on the first and the last path of a range may go on in its neighbours. They leave the task as
two paths with what is known so far, and the paths of many ranges run through the same stack again, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import cut, map_columns

#: Bytes of a turn's digest (of SHA-256).
KEY = 16
#: Bytes of sequences in a sorted run and in a range; paths of so many ranges are joined by one task.
RUN_BYTES, RANGE_BYTES, JOINED = 1 << 20, 8 << 20, 32
#: Parts over which the children of one node are spread where they meet its least conversation.
SPREAD = 16
#: Ids of one node that are one row on their way to its hash.
IDS = 4096

NODE = "node binary, parent binary, conv_id long, parent_conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
PATH = "range long, last int, keys binary, chars array<long>, n array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>"
MEASURES = ("chars", "n", "least", "children", "leaves", "saved")
_NONE = (1 << 63) - 1


def turn_digest(role: Column, text: Column) -> Column:
    """The digest of a turn; nulls are empty."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 2 * KEY))


def shared(a: bytes, b: bytes, start: int) -> int:
    """The turns that two sequences share, at least `start` of them."""
    most = min(len(a), len(b)) // KEY
    n = start
    while n < most and a[n * KEY : n * KEY + KEY] == b[n * KEY : n * KEY + KEY]:
        n += 1
    return n


class Run:
    """A sorted run: sequences without what they share with the one before, and the number of turns that they share."""

    def __init__(self, rows: list[tuple]) -> None:
        rows.sort(key=lambda r: r[0])
        self.shared, self.tails, self.rest = [], [], []
        before = b""
        for keys, *rest in rows:
            n = shared(before, keys, 0)
            self.shared.append(n)
            self.tails.append(keys[n * KEY :])
            self.rest.append(rest)
            before = keys

    def __iter__(self) -> Iterator[tuple]:
        """(sequence, turns shared with the one before, rest)."""
        before = b""
        for n, tail, rest in zip(self.shared, self.tails, self.rest, strict=True):
            before = before[: n * KEY] + tail
            yield before, n, rest


class LoserTree:
    """Merges sorted runs. Each waiting sequence knows what it shares with the last one that came out, so of two that
    share different amounts the one that shares more is first, and only equal amounts need a look at turns beyond them."""

    def __init__(self, runs: list[Run]) -> None:
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.sources = [iter(r) for r in runs] + [iter(())] * (self.size - len(runs))
        self.heads = [next(s, None) for s in self.sources]
        self.lcp = [0] * self.size  # with the last sequence out; none so far
        self.compared = 0
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _play(self, place: int) -> int:
        if place >= self.size:
            return place - self.size
        winner, self.losers[place] = self._match(self._play(2 * place), self._play(2 * place + 1))
        return winner

    def _match(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if self.lcp[i] != self.lcp[j]:
            return (i, j) if self.lcp[i] > self.lcp[j] else (j, i)
        start = self.lcp[i]
        n = shared(a[0], b[0], start)
        self.compared += n - start + 1
        if a[0][n * KEY : n * KEY + KEY] <= b[0][n * KEY : n * KEY + KEY]:
            self.lcp[j] = n
            return i, j
        self.lcp[i] = n
        return j, i

    def __iter__(self) -> Iterator[tuple]:
        """(sequence, turns shared with the one before, rest) of all runs in order."""
        while (head := self.heads[self.winner]) is not None:
            w = self.winner
            yield head[0], self.lcp[w], head[2]
            self.heads[w] = next(self.sources[w], None)
            if self.heads[w] is not None:
                self.lcp[w] = self.heads[w][1]  # what came out last is the one before it in its run
            place = (w + self.size) // 2
            while place:
                w, self.losers[place] = self._match(w, self.losers[place])
                place //= 2
            self.winner = w


class Open:
    """A node on the open path."""

    __slots__ = ("chars", "n", "least", "children", "leaves", "saved", "first", "node", "waiting")

    def __init__(self, chars: int, first: bool, node: bytes) -> None:
        self.chars, self.first, self.node = chars, first, node
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.waiting = _NONE, []


class Stack:
    """Takes paths in order and gives the nodes that are finished; with `whole`, those of the first and last path too."""

    def __init__(self, whole: bool) -> None:
        self.whole, self.path, self.keys = whole, [], b""
        self.hashes: list = []
        self.first: list[Open] | None = None
        self.first_keys = b""
        self.done: list[tuple] = []

    def add(self, keys: bytes, lcp: int, chars: list, n: list, least: list, children: list, leaves: list, saved: list) -> None:
        """One path, from the root (which has no turn) down; lcp: turns that it shares with the one before."""
        self._close(lcp + 1 if self.path else 0)
        for d in range(len(self.path), len(keys) // KEY + 1):
            h = self.hashes[d - 1].copy() if d else hashlib.sha256()
            if d:
                h.update(keys[(d - 1) * KEY : d * KEY])
            self.hashes.append(h)
            self.path.append(Open(chars[d], self.first is None, h.digest()[:KEY]))
        for d in range(len(keys) // KEY + 1):
            o = self.path[d]
            o.n += n[d]
            o.least = min(o.least, least[d])
            o.children += children[d]
            o.leaves += leaves[d]
            o.saved += saved[d]
        if self.first is None:
            self.first, self.first_keys = list(self.path), keys
        self.keys = keys

    def _close(self, depth: int) -> None:
        while len(self.path) > depth:
            self.hashes.pop()
            self._finish(self.path.pop(), len(self.path), self.path[-1] if self.path else None)

    def _finish(self, o: Open, depth: int, above: Open | None) -> None:
        if o.first and not self.whole:
            self._pass_on(o)  # more of it may be in the ranges before: it waits in the first path
            return
        leaves, saved = o.leaves or 1, o.saved + (o.n - 1) * o.chars
        row = (o.node, above.node if above else None, o.least, None, depth, o.n, o.children, leaves, saved)
        self.done += [(*r[:3], o.least, *r[4:]) for r in o.waiting]
        if above:
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            above.waiting.append(row)
        else:
            self.done.append(row)

    def _pass_on(self, o: Open) -> None:
        """Children whose parent isn't finished here go without its least conversation."""
        self.done += o.waiting
        o.waiting = []

    def end(self) -> list[tuple[bytes, list[Open]]]:
        """The first and the last path with what is known of their nodes; none with `whole`."""
        if self.whole or self.first is None:
            self._close(0)
            return []
        n = len(self.first_keys) // KEY + 1
        still = 0
        while still < min(n, len(self.path)) and self.path[still] is self.first[still]:
            still += 1
        for o in self.path:
            self._pass_on(o)
        blank = []
        for o in self.first[:still]:  # what both paths have is told once, by the last
            blank.append(Open(o.chars, True, o.node))
        return [(self.first_keys, blank + self.first[still:]), (self.keys, self.path)]


def _nodes(rows: list[tuple]) -> dict:
    names = [f.split()[0] for f in NODE.split(", ")]
    return dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}


OUT = f"{NODE}, {PATH}"


def _rows(nodes: list[tuple], paths: list[tuple[int, int, bytes, list[Open]]]) -> dict:
    """Finished nodes and paths as rows of one table; a path has a range, a node none."""
    out = _nodes(nodes)
    for name in out:
        out[name] = [*out[name], *[None] * len(paths)]
    blank = [None] * len(nodes)
    out |= {"range": [*blank, *[p[0] for p in paths]], "last": [*blank, *[p[1] for p in paths]], "keys": [*blank, *[p[2] for p in paths]]}
    return out | {m: [*blank, *[[getattr(o, m) for o in p[3]] for p in paths]] for m in MEASURES}


def _drain(stack: Stack, at: int, step: int = 4096) -> Iterator[dict]:
    if len(stack.done) >= step:
        yield _rows(stack.done, [])
        stack.done = []


def _close_range(stack: Stack, at: int) -> Iterator[dict]:
    paths = stack.end()
    yield _rows(stack.done, [(at, k, keys, nodes) for k, (keys, nodes) in enumerate(paths)])


def merge_ranges(sequences: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Finished nodes and border paths of (range, keys, chars, n, least), dealt out by ranges of keys."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        runs, rows, held, at = [], [], 0, 0
        for batch in batches:
            names = ("range", "keys", "chars", "n", "least")
            for at, keys, chars, n, least in zip(*(batch[c].to_pylist() for c in names), strict=True):
                rows.append((keys, chars, n, least))
                held += len(keys) + 64
                if held >= run_bytes:
                    runs.append(Run(rows))
                    rows, held = [], 0
        if rows:
            runs.append(Run(rows))
        if not runs:
            return
        stack = Stack(False)
        for keys, lcp, (chars, n, least) in LoserTree(runs):
            d = len(keys) // KEY + 1
            zero = [0] * d
            stack.add(keys, lcp, [0, *chars], [n] * d, [least] * d, zero, zero, zero)
            yield from _drain(stack, at)
        yield from _close_range(stack, at)

    return map_columns(sequences, run, OUT)


def merge_borders(paths: DataFrame, group: Column, whole: bool) -> DataFrame:
    """Finished nodes and border paths of the border paths of several ranges, which come in the order of the ranges."""
    dealt = paths.withColumn("group", group).repartition("group").sortWithinPartitions("group", "range", "last")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        stack, now = Stack(whole), None
        for batch in batches:
            names = ("group", "keys", *MEASURES)
            for at, keys, *measures in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if now is not None and at != now:
                    yield from _close_range(stack, now)
                    stack = Stack(whole)
                now = at
                stack.add(keys, shared(stack.keys, keys, 0), *measures)
                yield from _drain(stack, at)
        if now is not None:
            yield from _close_range(stack, now)

    return map_columns(dealt, run, OUT)


def ids_hashes(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) for (node, id): the hash of a node's ids, ascending and comma-joined.

    Ids are dealt out by ranges, so those of one node may be in many tasks; each writes them as pieces of bounded size,
    and one task streams the pieces of a node through the hash, which has no other way.
    """
    parts = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = members.repartitionByRange(parts, "node", "id").sortWithinPartitions("node", "id")

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        node, ids, out = None, [], []
        for batch in batches:
            for own, i in zip(batch["node"].to_pylist(), batch["id"].to_pylist(), strict=True):
                if ids and (own != node or len(ids) >= IDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                    if len(out) >= 256:
                        yield dict(zip(("node", "id", "piece"), zip(*out, strict=True), strict=True))
                        out = []
                node = own
                ids.append(i)
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
        if out:
            yield dict(zip(("node", "id", "piece"), zip(*out, strict=True), strict=True))

    def hashes(batches: Iterator[dict]) -> Iterator[dict]:
        node, h, out = None, None, []
        for batch in batches:
            for own, piece in zip(batch["node"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if own == node:
                    h.update(b"," + piece.encode())
                else:
                    if h:
                        out.append((node, h.hexdigest()))
                    node, h = own, hashlib.sha256(piece.encode())
            if len(out) >= 4096:
                yield dict(zip(("node", "ends_sha256"), zip(*out, strict=True), strict=True))
                out = []
        if h:
            out.append((node, h.hexdigest()))
        if out:
            yield dict(zip(("node", "ends_sha256"), zip(*out, strict=True), strict=True))

    cut_up = map_columns(ordered, pieces, "node binary, id long, piece string")
    return map_columns(cut_up.repartition("node").sortWithinPartitions("node", "id"), hashes, "node binary, ends_sha256 string")


def sequences_of(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns: array of key, chars) of every conversation: its turns by number, null first, ties by digest.

    Texts are read once, for their digests; a turn is then 16 bytes and a number, and a conversation one row of them.
    Rows with a null conversation belong to none.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("key"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"))
    read = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return read.groupBy("id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, head_of: Column, head: Column, most: int) -> DataFrame:
    """(id, turns) with the first `head` turns (`most` at most) taken from the conversation `head_of`, none if there is none."""
    heads = conversations.select(F.col("id").alias("of"), F.slice("turns", F.lit(1), F.lit(most)).alias("start"))
    joined = conversations.withColumn("of", head_of).join(heads, "of", "left")
    start = F.coalesce(F.slice("start", F.lit(1), head), F.array().cast(conversations.schema["turns"].dataType))
    own = F.slice("turns", head + 1, F.greatest(F.size("turns") - head, F.lit(0)))
    return joined.select("id", F.concat(start, own).alias("turns"))


def prefix_trie(conversations: DataFrame, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, joined: int = JOINED) -> DataFrame:
    """The nodes of the trie of (id, turns: array of key, chars): node, parent, conv_id, parent_conv_id, depth, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns, `node` the start of the SHA-256 of their digests; the root has none.
    Its members are the conversations that begin with it, turnless ones are members of the root alone. Rows that repeat
    an id are members each. No conversation, no node. A conversation is one row of 24 bytes a turn wherever it goes.
    """
    if joined < 2:
        raise ValueError("borders of two ranges or more are joined at a time")
    keys = F.when(F.size("turns") == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")))
    node = F.unhex(F.substring(F.sha2("keys", 256), 1, 2 * KEY))
    members = cut(conversations.select("id", keys.alias("keys"), F.col("turns.chars").alias("chars")).withColumn("node", node), "members")
    sequences = cut(members.groupBy("keys", "chars").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "sequences")
    total = sequences.agg(F.sum(F.octet_length("keys").cast("long") + 64)).head()[0] or 0
    ranged = sequences.repartitionByRange(max(1, -(-total // range_bytes)), "keys").withColumn("range", F.spark_partition_id().cast("long"))
    found = cut(merge_ranges(ranged, run_bytes), "nodes")
    nodes = found.filter("range is null").select(*_nodes([]))
    while True:
        paths = found.filter("range is not null").select(*[f.split()[0] for f in PATH.split(", ")])
        span = paths.agg(F.max("range")).head()[0]
        if span is None:
            break
        whole = span < joined  # one task joins what is left
        found = cut(merge_borders(paths, F.floor(F.col("range") / joined), whole), "borders")
        nodes = nodes.unionByName(found.filter("range is null").select(*_nodes([])))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("known"))
    lone = nodes.filter("parent_conv_id is null and parent is not null")
    rest = nodes.filter("parent_conv_id is not null or parent is null")
    wanted = parents.join(lone.select("parent").distinct(), "parent", "left_semi")  # nodes on borders alone
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    lone = lone.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"))
    placed = rest.unionByName(lone.join(wanted, ["parent", "part"]).withColumn("parent_conv_id", F.col("known")).select(*rest.columns))
    ends = ids_hashes(members.select("node", "id"))
    return placed.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
