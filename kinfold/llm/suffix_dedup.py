"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A sparse suffix array decides which strings of `length` bytes start earlier elsewhere. Suffixes start at anchors: the
position in each window of `length` bytes whose short gram has the least hash. Anchors depend on the bytes of the
window alone, so equal windows have equal anchors, and all windows with the same anchor (a family) are settled together.

Every task sorts the suffixes of its families, front-codes the sorted run (only the bytes after the common prefix with
the suffix before) and cuts it at splitters from a bounded sample. The exchanged runs are merged by a loser tree that
keeps common prefixes with the last winner and never compares those bytes again. Equal families are neighbours in the
merged order: all but the first repeat. Families that share just a part with a neighbour have those windows sorted in
the same way.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded, map_columns

LENGTH = 100
#: Text bytes of one sorted run and of one slice that is hashed at a time.
RUN_BYTES, SLICE = 8 << 20, 1 << 20
#: Text bytes of a partition of the merge, about.
PART_BYTES = 16 << 20
#: The splitters' sample: about so many texts, so many grams of each at most.
SAMPLED_TEXTS, SAMPLED_GRAMS = 2000, 50
#: Windows sorted at once, and families held until their neighbours are known.
BUFFERED, HELD = 200_000, 50_000
#: Rows with a null id come first.
LEAST_ID = -(1 << 63)


class Shape:
    """Bytes of a gram, windows of a family and columns of a sort row (right of the anchor, left of it reversed, both lengths)."""

    def __init__(self, length: int):
        if not 8 <= length <= 255:
            raise ValueError("lengths from 8 to 255 bytes are supported")
        self.length, self.gram = length, max(4, length // 6)
        self.windows = length - self.gram + 1
        self.left = self.windows - 1
        self.width = length + self.left + 2


def gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes, by doubling."""
    a, b = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    power = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    power ^= power >> np.uint64(29)
    got, done, size = None, 0, 1
    while True:
        if k & size:
            if got is None:
                got, done = power, size
            else:
                n = len(power) - done
                got = got[:n] * a + power[done : done + n]
                got ^= got >> np.uint64(32)
                done += size
        size *= 2
        if size > k:
            return got
        n = len(power) - size // 2
        power = power[:n] * b + power[size // 2 :]
        power ^= power >> np.uint64(31)


def least_positions(hashes: np.ndarray, w: int) -> np.ndarray:
    """For each w hashes in a row, the position of the first least one."""
    v = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    n = len(v) - w + 1
    blocks = np.concatenate([v, np.full((-len(v)) % w + w, np.uint64(2**64 - 1))]).reshape(-1, w)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(since[:n], upto[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def families(pieces: list[bytes], s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, piece, first window, last window, anchor) of all families; positions are in the joined bytes."""
    x = np.frombuffer(b"".join(pieces), np.uint8)
    if len(x) < s.length:
        none = np.zeros(0, np.int64)
        return x, none, none, none, none
    anchors = least_positions(gram_hashes(x, s.gram), s.windows)
    sizes = np.array([len(p) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(anchors)]
    whole = np.arange(len(anchors)) + s.length <= np.cumsum(sizes)[piece]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchors)) - 1
    ok = whole[first]
    first, last = first[ok], last[ok]
    return x, piece[first], first, last, anchors[first]


def sort_rows(x: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, s: Shape) -> np.ndarray:
    """[family, width] bytes: what families are sorted by. Equal rows are families with equal windows."""
    right, left = last + s.length - anchor, anchor - first
    rows = np.zeros((len(first), s.width), np.uint8)
    j = np.arange(s.length)
    np.multiply(x[np.minimum(anchor[:, None] + j, len(x) - 1)], j < right[:, None], out=rows[:, : s.length], casting="unsafe")
    j = np.arange(s.left)
    np.multiply(x[np.maximum(anchor[:, None] - 1 - j, 0)], j < left[:, None], out=rows[:, s.length : s.length + s.left], casting="unsafe")
    rows[:, -2], rows[:, -1] = left, right
    return rows


def as_strings(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def order_of(rows: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order by row, then id, then position."""
    by_place = np.lexsort((at, ids))
    head = np.ascontiguousarray(rows[by_place, :8]).view(">u8").ravel().astype(np.uint64)
    got = by_place[np.argsort(head, kind="stable")]
    # Only rows with equal heads are left to sort.
    h = np.ascontiguousarray(rows[got, :8]).view(">u8").ravel()
    same = np.zeros(len(got), bool)
    same[1:] = h[1:] == h[:-1]
    same[:-1] |= same[1:]
    some = np.flatnonzero(same)
    if len(some):
        got[some] = got[some][np.argsort(as_strings(rows[got[some]]), kind="stable")]
    return got


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before (0 for the first; the width if they are equal)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1])
    return out


def settle(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, equal: np.ndarray, spans: Spans, ends: np.ndarray) -> np.ndarray:
    """Of each run of equal rows the first stays, and later places are spans; gives a mask of the first ones."""
    group = np.flatnonzero(~equal)[np.cumsum(~equal) - 1] if len(ids) else np.zeros(0, np.int64)
    late = equal & ((ids != ids[group]) | (at != at[group]))
    spans.add(ids[late], keys[late], at[late], ends[late])
    tied = equal & ~late & (keys != keys[group])  # another text with the same id and start: neither is earlier
    return ~equal | tied


class Spans:
    """Byte ranges by document, given out as one packed row for each document."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, ids, keys, first, ends) -> None:
        if len(ids):
            self.parts.append((np.asarray(ids, np.int64), np.asarray(keys, np.int64), np.asarray(first, np.int64), np.asarray(ends, np.int64)))
            self.n += len(ids)

    def rows(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.parts:
            return
        ids, keys, first, ends = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.n = [], 0
        order = np.lexsort((first, keys, ids))
        ids, keys, first, ends = ids[order], keys[order], first[order], ends[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        borders = [*np.flatnonzero(new), len(ids)]
        for a, b in zip(borders, borders[1:], strict=False):
            yield int(ids[a]), int(keys[a]), joined(first[a:b], ends[a:b]).tobytes()


def joined(first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Overlapping or touching ranges, sorted by their begin, as one: [range, 2]."""
    upto = np.maximum.accumulate(ends)
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > upto[:-1]
    at = np.flatnonzero(new)
    return np.stack([first[at], np.append(upto[at[1:] - 1], upto[-1:])], axis=1).astype("<i8")


def planes(column: np.ndarray) -> bytes:
    """The lowest byte of every number, then the second ...: ids and places have few bytes that vary."""
    return np.ascontiguousarray(column.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").ravel()


def front_coded(rows: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray) -> bytes:
    """A sorted run: of each row the bytes after its common prefix with the one before."""
    lcp = prefixes(rows)
    tails = zstandard.ZstdCompressor(level=5).compress(rows[np.arange(rows.shape[1]) >= lcp[:, None]].tobytes())
    numbers = zstandard.ZstdCompressor(level=1).compress(b"".join(planes(c) for c in (lcp, ids, keys, at)))
    return struct.pack("<QQ", len(rows), len(numbers)) + numbers + tails


class Run:
    """A front-coded run, read row by row."""

    __slots__ = ("at", "begin", "i", "ids", "keys", "lcps", "n", "row", "tails", "width")

    def __init__(self, data: bytes, width: int):
        self.n, size = struct.unpack_from("<QQ", data)
        n, unpack = self.n, zstandard.ZstdDecompressor().decompress
        numbers = unpack(data[16 : 16 + size])
        self.lcps = from_planes(numbers, n, 0).tolist()
        self.ids, self.keys, self.at = (from_planes(numbers, n, 8 * n * i) for i in (1, 2, 3))
        self.tails = unpack(data[16 + size :])
        self.width, self.i, self.begin, self.row = width, -1, 0, b""

    def step(self) -> int:
        """Goes to the next row; gives its common prefix with the row before, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        lcp = self.lcps[self.i]
        end = self.begin + self.width - lcp
        self.row = self.row[:lcp] + self.tails[self.begin : end]
        self.begin = end
        return lcp


def merged(runs: list[Run]) -> Iterator[tuple[int, Run]]:
    """(common prefix with the row before, run that stands at the row) of all rows in order, by a loser tree.

    lcps[k] is the common prefix of run k's row with the last row that beat it. Of two rows after the same winner the
    one with the longer common prefix comes first; with equal ones, bytes are compared from there on.
    """
    runs = [r for r in runs if r.n]
    if not runs:
        return
    size = 1
    while size < len(runs):
        size *= 2
    lcps = [r.step() for r in runs] + [-1] * (size - len(runs))
    width = runs[0].width
    losers = [0] * size

    def beats(k: int, o: int) -> bool:
        """Whether run k's row comes before run o's; the loser's common prefix is then with the winner."""
        h, g = lcps[k], lcps[o]
        if h != g:
            return h > g
        if h < 0:
            return True
        a, b = runs[k].row, runs[o].row
        if a == b:
            lcps[o] = width
            return True
        while a[h : h + 16] == b[h : h + 16]:
            h += 16
        while a[h] == b[h]:
            h += 1
        if a[h] < b[h]:
            lcps[o] = h
            return True
        lcps[k] = h
        return False

    def build(node: int) -> int:
        if node >= size:
            return node - size
        k, o = build(2 * node), build(2 * node + 1)
        if not beats(k, o):
            k, o = o, k
        losers[node] = o
        return k

    k = build(1)
    while lcps[k] >= 0:
        yield lcps[k], runs[k]
        lcps[k] = runs[k].step()
        node = (k + size) >> 1
        while node:
            o = losers[node]
            h, g = lcps[k], lcps[o]
            if g > h or (g == h and g >= 0 and not beats(k, o)):
                losers[node], k = k, o
            node >>= 1


class Windows:
    """Single windows whose families are alike in part: sorted in runs, and the runs merged, at the end of a gram.

    Equal windows have the same gram, so several grams may be settled at once but none in two parts.
    """

    def __init__(self, s: Shape, spans: Spans):
        self.s, self.spans = s, spans
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0
        self.runs: list[bytes] = []

    def add(self, row: bytes, ident: int, key: int, first: int, low: int, high: int) -> None:
        """The windows of a family with low to high bytes left of the anchor."""
        s, n_left, n_right = self.s, row[-2], row[-1]
        low, high = max(low, s.length - n_right, 0), min(high, n_left)
        if low > high:
            return
        whole = np.frombuffer(row[s.length : s.length + n_left][::-1] + row[:n_right], np.uint8)
        n = high - low + 1
        begin = n_left - high
        rows = np.lib.stride_tricks.sliding_window_view(whole, s.length)[begin : begin + n]
        self.parts.append((rows, ident, key, first + begin + np.arange(n)))
        self.n += n

    def _sorted(self) -> tuple[np.ndarray, ...]:
        sizes = [len(p[0]) for p in self.parts]
        rows = np.concatenate([p[0] for p in self.parts])
        ids, keys = (np.repeat(np.array([p[i] for p in self.parts], np.int64), sizes) for i in (1, 2))
        at = np.concatenate([p[3] for p in self.parts])
        self.parts, self.n = [], 0
        order = order_of(rows, ids, at)
        rows, ids, keys, at = rows[order], ids[order], keys[order], at[order]
        stay = settle(ids, keys, at, prefixes(rows) == self.s.length, self.spans, at + self.s.length)
        return rows[stay], ids[stay], keys[stay], at[stay]

    def spill(self) -> None:
        """Inside a gram: keep what is there as a front-coded run."""
        self.runs.append(front_coded(*self._sorted()))

    def close(self, last: bool = False) -> None:
        """After the last family of a gram; few windows wait for those of the next grams."""
        if not self.runs and (last or self.n > BUFFERED // 2):
            if self.parts:
                self._sorted()
        if not self.runs:
            return
        if self.parts:
            self.spill()
        same = Same(self.spans, lambda first, row: first + self.s.length)
        for lcp, run in merged([Run(r, self.s.length) for r in self.runs]):
            same.put(lcp == self.s.length, run)
        same.close()
        self.runs = []


class Same:
    """Settles runs of equal rows of a merge: the earliest place stays, the others are spans."""

    def __init__(self, spans: Spans, end_of):
        self.spans, self.end_of = spans, end_of
        self.rows: list[tuple[int, int, int, int]] = []

    def put(self, equal: bool, run: Run) -> None:
        if not equal:
            self.close()
        i = run.i
        at = int(run.at[i])
        self.rows.append((int(run.ids[i]), at, int(run.keys[i]), self.end_of(at, run.row)))

    def close(self) -> None:
        if len(self.rows) > 1:
            least = min(r[:2] for r in self.rows)
            late = [r for r in self.rows if r[:2] != least]
            if late:
                ids, at, keys, ends = zip(*late, strict=True)
                self.spans.add(ids, keys, at, ends)
        self.rows = []


def merge_families(blobs: list[bytes], s: Shape, spans: Spans) -> Iterator[None]:
    """Merges the runs of one partition; yields now and then, so that the spans so far can go out."""
    windows = Windows(s, spans)
    same = Same(spans, lambda first, row: first + row[-2] + row[-1])
    # Families of one right side, all rows equal up to the left side: (row, id, key, first, common prefix with the one before).
    block: list[tuple[bytes, int, int, int, int]] = []
    before = 0  # common prefix of the block with the one before it

    def emit(after: int) -> None:
        """The block's neighbours are known: windows that a neighbour may share."""
        if len(block) == 1 and before < s.gram and after < s.gram:
            return
        shared = max(before, after)
        for j, (row, ident, key, first, lcp) in enumerate(block):
            low = s.length - shared
            if len(block) > 1:  # the same right side: as many bytes to the left as a neighbour shares
                left = max(lcp if j else 0, block[j + 1][4] if j + 1 < len(block) else 0) - s.length
                if left >= low - 1:
                    windows.add(row, ident, key, first, 0, s.left)
                    continue
                windows.add(row, ident, key, first, 0, left)
            if shared >= s.gram:
                windows.add(row, ident, key, first, low, s.left)

    for lcp, run in merged([Run(b, s.width) for b in blobs]):
        if lcp == s.width:
            same.put(True, run)
            i = run.i  # the block holds the earliest place of a family
            row, ident, key, first, own = block[-1]
            place = (int(run.ids[i]), int(run.at[i]))
            if place < (ident, first):
                block[-1] = (row, place[0], int(run.keys[i]), place[1], own)
            elif place == (ident, first) and int(run.keys[i]) != key:
                block.append((row, *place[:1], int(run.keys[i]), place[1], s.width))
            continue
        same.put(False, run)
        i = run.i
        if lcp < s.length and block:
            emit(lcp)
            block, before = [], lcp
            if lcp < s.gram:
                windows.close()
            if spans.n > 2 * BUFFERED:
                yield
        elif len(block) >= HELD:  # too many to wait for the neighbours: any window may be shared
            emit(s.length)
            block, before = block[-1:], s.length
        if windows.n > BUFFERED:
            windows.spill()
        block.append((run.row, int(run.ids[i]), int(run.keys[i]), int(run.at[i]), lcp))
    same.close()
    emit(0)
    windows.close(last=True)
    yield


def sorted_runs(batches: Iterator[dict], s: Shape, splitters: np.ndarray, parts: int) -> Iterator[dict]:
    """Rows (part, id, key, data) of front-coded runs (id null) and of spans that a run settles by itself."""
    own: list[tuple[np.ndarray, ...]] = []
    spans = Spans()

    def flush() -> dict:
        rows, ids, keys, at = (np.concatenate(x) for x in zip(*own, strict=True))
        own.clear()
        order = order_of(rows, ids, at)
        rows, ids, keys, at = rows[order], ids[order], keys[order], at[order]
        ends = at + rows[:, -2] + rows[:, -1]
        stay = settle(ids, keys, at, prefixes(rows) == s.width, spans, ends)
        rows, ids, keys, at = rows[stay], ids[stay], keys[stay], at[stay]
        borders = [0, *np.searchsorted(as_strings(rows[:, : s.gram]), splitters, side="left").tolist(), len(rows)]
        out: dict[str, list] = {"part": [], "id": [], "key": [], "data": []}

        def put(*values) -> None:
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)

        for p, (a, b) in enumerate(zip(borders, borders[1:], strict=False)):
            if b > a:
                put(p, None, None, front_coded(rows[a:b], ids[a:b], keys[a:b], at[a:b]))
        for ident, key, data in spans.rows():  # they only pass through; copies of one text go to different parts
            put((ident * 0x9E3779B1 + key) % parts, ident, key, data)
        return out

    total = 0
    pieces: list[tuple[bytes, int, int, int]] = []

    def hashed() -> None:
        x, piece, first, last, anchor = families([p[0] for p in pieces], s)
        if len(first):
            begin = np.cumsum([0] + [len(p[0]) for p in pieces])[piece]
            ids, keys, offset = (np.array([p[i] for p in pieces], np.int64)[piece] for i in (1, 2, 3))
            own.append((sort_rows(x, first, last, anchor, s), ids, keys, first - begin + offset))
        pieces.clear()

    held = 0
    for batch in batches:
        texts = batch["text"]
        for ident, key, text in zip(batch["id"].to_pylist(), batch["key"].to_pylist(), texts, strict=True):
            data = (text.as_py() or "").encode()
            for a in range(0, len(data) - s.length + 1, SLICE):
                pieces.append((data[a : a + SLICE + s.length - 1], ident, key, a))
                held += len(pieces[-1][0])
                if held >= SLICE:
                    hashed()
                    total, held = total + held, 0
                if total >= RUN_BYTES:
                    if own:
                        yield flush()
                    total = 0
    if pieces:
        hashed()
    if own:
        yield flush()


def sampled_splitters(read: DataFrame, s: Shape, parts: int) -> np.ndarray:
    """parts - 1 grams that cut a bounded sample of anchors evenly."""
    rows = read.count()
    sample = read.sample(min(1.0, SAMPLED_TEXTS / max(rows, 1)), seed=17) if rows > SAMPLED_TEXTS else read

    def grams(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for text in batch["text"]:
                data = (text.as_py() or "").encode()
                x, _, _, _, anchor = families([data[: 4 * SLICE]], s)
                picked = anchor[:: max(1, len(anchor) // SAMPLED_GRAMS)][:SAMPLED_GRAMS]
                yield {"gram": [x[a : a + s.gram].tobytes() for a in picked.tolist()]}

    found = sorted(bytes(r["gram"]) for r in map_columns(sample.select("text"), grams, "gram binary").collect())
    cuts = sorted({found[len(found) * p // parts] for p in range(1, parts)}) if found else []
    return np.array(cuts, f"S{s.gram}")


def parts_for(docs: DataFrame) -> int:
    """As many partitions as the session shuffles to, or more for a large table."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(size, 1 << 50) // PART_BYTES) if size < 1 << 50 else least


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID))
    key = F.xxhash64(text).bitwiseAND((1 << 32) - 1)  # tells apart texts that repeat an id
    return docs.select(F.col(id_col).alias("own"), ident.alias("id"), key.alias("key"), text.alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, key, spans): packed byte ranges (little-endian 64-bit begin and end) that repeat earlier bytes; several rows a document may come."""
    s = Shape(length)
    read = _read(docs, id_col, text_col)
    parts = parts_for(docs)
    splitters = sampled_splitters(read, s, parts)
    runs = map_columns(read.select("id", "key", "text"), lambda b: sorted_runs(b, s, splitters, parts), "part int, id long, key long, data binary")

    def merge(batches: Iterator[dict]) -> Iterator[dict]:
        blobs: list[bytes] = []
        for batch in batches:
            passed: dict[str, list] = {"id": [], "key": [], "spans": []}
            for ident, key, data in zip(batch["id"].to_pylist(), batch["key"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if ident is None:
                    blobs.append(data)
                else:
                    for c, v in zip(passed.values(), (ident, key, data), strict=True):
                        c.append(v)
            yield passed
        spans = Spans()
        for _ in merge_families(blobs, s, spans):
            rows = list(spans.rows())
            yield {n: [r[i] for r in rows] for i, n in enumerate(("id", "key", "spans"))}

    dealt = runs.repartitionById(parts, F.col("part"))
    return map_columns(dealt.select("id", "key", "data"), merge, "id long, key long, spans binary")


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: id, n_bytes, spans (array of begin and end, maximal removed byte runs), kept (binary).

    Texts are UTF-8 bytes, null as none. A byte goes if a string of `length` bytes that covers it also starts earlier:
    at a smaller id, or in the same document before. Rows with a null id come first. Rows that repeat an id are one
    place: a string at the same id and start is not earlier, whichever row holds it; rows equal in id and text get
    equal results. Cuts may fall inside a character, so what is kept is binary. Other columns of docs are not read.
    """
    read = _read(docs, id_col, text_col)
    found = repeated_spans(docs, id_col, text_col, length).groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))
    both = read.join(found.hint("shuffle_hash"), ["id", "key"], "left").select("own", "text", "spans")

    def strip(batches: Iterator[dict]) -> Iterator[dict]:
        for batch, a, b in ((batch, a, b) for batch in batches for a, b in bounded(batch["text"])):
            out: dict[str, list] = {"n_bytes": [], "spans": [], "kept": []}
            for text, packed in zip(batch["text"][a:b], batch["spans"][a:b], strict=True):
                data = text.as_py().encode()
                kept, ranges = data, []
                if packed.is_valid:
                    got = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in packed.as_py()])
                    ranges = joined(*got[np.argsort(got[:, 0], kind="stable")].T).tolist()
                    borders = [0, *[x for r in ranges for x in r], len(data)]
                    kept = b"".join([data[i:j] for i, j in zip(borders[::2], borders[1::2], strict=True)])
                out["n_bytes"].append(len(data))
                out["spans"].append([{"begin": i, "end": j} for i, j in ranges])
                out["kept"].append(kept)
            yield {"id": batch["own"][a:b], **out}

    kind = docs.schema[id_col].dataType.simpleString()
    types = f"id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    return map_columns(both, strip, types).withColumnRenamed("id", id_col)

