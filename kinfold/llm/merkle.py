"""Merkle manifest of a dataset over a radix-ranked trie.

Every row is a leaf. Its exact rank within its group comes from histograms of the digits of its id: the histogram of a
prefix is added up level by level into the number of rows before it, and only the few rows of one bucket are ordered
among themselves, so nothing is sorted as a whole. A bucket that still holds many rows is counted again by longer
prefixes (a heavy id by the digits of its leaf, repeated rows by their row number). The base-fanout digits of a rank
name the trie nodes above a leaf; nodes that share the longest prefix are reduced first, several digits at a time, until
each group has one node, the groups' nodes likewise, and the siblings are handed down again as proofs. DataFrame
functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import cut

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that a bucket of a histogram should hold; one with four times as many is counted by longer prefixes.
BUCKET = 512
#: Nodes that are reduced in one row: so many digits of a rank as fit.
WIDTH = 2187
#: Digits of a histogram that are added up in one window, and parts over which a heavy bucket is spread when it is split.
STEP, SPREAD = 3, 16
_LEAST_LONG = -(1 << 63)


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def _digits(n: int, bucket_rows: int) -> int:
    """The hexadecimal digits that leave so many of n evenly spread rows to a bucket."""
    digits = 0
    while n > bucket_rows << (4 * digits):
        digits += 1
    return digits


def _common(low: str, high: str) -> int:
    return next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))


def _common_column(low: Column, high: Column) -> Column:
    same = lambda n, i: F.when((n == i - 1) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))), i).otherwise(n)
    return F.aggregate(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), F.lit(0), same)


def radix_ranks(rows: DataFrame, key: Column, order: list[str], bucket_rows: int = BUCKET) -> DataFrame:
    """rows (a written table with a column `g`) with their rank from 0 within g and n, the rows of g.

    key: a text of hexadecimal digits, not empty, in the same order as the columns `order`, and unique within g (or
    equal rows are ranked in any order). Only one row of figures reaches the driver each time.
    """
    low, high, total = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).head()
    if not total:
        return rows.select("*", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("n"))
    start = _common(low, high)
    now = rows.withColumn("digits", F.lit(start + _digits(total, bucket_rows)))
    bucket = F.substr(key, F.lit(1), F.col("digits")).alias("bucket")
    while True:
        counted = now.groupBy("g", bucket).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        hist = cut(counted, "histogram")
        full = hist.filter((F.col("n") > 4 * bucket_rows) & (F.col("low") < F.col("high")))
        if full.isEmpty():
            break
        more = F.ceil(F.log2(F.col("n") / bucket_rows) / 4).cast("int")
        longer = full.select("g", "bucket", (_common_column(F.col("low"), F.col("high")) + more).alias("longer"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
        placed = now.select("*", bucket, F.pmod(F.xxhash64(*order), F.lit(SPREAD)).cast("int").alias("part"))
        joined = placed.join(longer, ["g", "bucket", "part"], "left")
        now = cut(joined.select(*rows.columns, F.coalesce("longer", "digits").alias("digits")), "placed")
    firsts = rows_before(hist.select("g", "bucket", "n"), start)
    local = F.row_number().over(Window.partitionBy("g", "bucket").orderBy(*order)) - 1
    ranked = now.select(*rows.columns, bucket).withColumn("local", local).join(firsts, ["g", "bucket"])
    return ranked.select(*rows.columns, (F.col("first") + F.col("local")).alias("rank"), "n")


def rows_before(hist: DataFrame, start: int) -> DataFrame:
    """(g, bucket, first, n) for (g, bucket, n): the rows of g in smaller buckets and all its rows.

    Buckets are prefixes of which none begins another; the digits before `start` are equal. Each level adds up at most
    16 ** STEP siblings.
    """
    longest = hist.agg(F.max(F.length("bucket"))).head()[0]
    placed = hist.select("g", "bucket", F.lit(0).cast("long").alias("first"))
    for upto in range(start, longest, STEP):
        parent, node = (F.substring("bucket", 1, k) for k in (upto, upto + STEP))
        nodes = hist.groupBy("g", parent.alias("parent"), node.alias("node")).agg(F.sum("n").alias("n"))
        smaller = Window.partitionBy("g", "parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.select("g", "node", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("more"))
        placed = placed.withColumn("node", node).join(nodes, ["g", "node"]).select("g", "bucket", (F.col("first") + F.col("more")).alias("first"))
        placed = cut(placed, "before")
    return placed.join(hist.groupBy("g").agg(F.sum("n").alias("n")), "g")


class Trie:
    """How many digits are reduced together, and the expressions for one row of nodes."""

    def __init__(self, fanout: int, width: int = WIDTH) -> None:
        if fanout < 2:
            raise ValueError("a fanout of 2 or more is needed")
        self.fanout, self.levels = fanout, 1
        while fanout ** (self.levels + 1) <= width:
            self.levels += 1
        self.width = fanout**self.levels
        self.powers = [fanout**i for i in range(63) if fanout**i < 1 << 63]

    def height(self, n: Column) -> Column:
        """Levels from n nodes to one."""
        return F.size(F.filter(F.array(*[F.lit(p) for p in self.powers]), lambda p: p < n))

    def tiers(self, hashes: Column, n: Column) -> Column:
        """The hashes and what they become level by level, as far as this row reaches."""

        def above(nodes: Column) -> Column:
            runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / self.fanout).cast("int") - 1)
            return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * self.fanout + 1, self.fanout), "").cast("binary"), 256))

        rounds = F.slice(F.array(*[F.lit(i) for i in range(self.levels)]), F.lit(1), F.least(self.height(n), F.lit(self.levels)))
        return F.aggregate(rounds, F.array(hashes), lambda tiers, _: F.concat(tiers, F.array(above(F.element_at(tiers, -1)))))

    def steps(self, tiers: Column, i: Column) -> Column:
        """For the i-th node of the lowest tier the siblings before and after it and those above it, tier by tier."""

        def step(nodes: Column, tier: Column) -> Column:
            at = F.floor(i / F.element_at(F.array(*[F.lit(p) for p in self.powers[: self.levels]]), tier + 1)).cast("int")
            own = at % self.fanout
            return F.struct(
                F.array_join(F.slice(nodes, at - own + 1, own), "").alias("before"),
                F.array_join(F.slice(nodes, at + 2, self.fanout - 1 - own), "").alias("after"),
            )

        return F.transform(F.slice(tiers, F.lit(1), F.size(tiers) - 1), step)


def climb(nodes: DataFrame, trie: Trie) -> tuple[list[DataFrame], DataFrame]:
    """Reduce (g, n, rank, hash, payload): the written rows of every height, lowest first, and (g, hash) of the tops."""
    tables = []
    while True:
        item = F.struct("rank", "hash", "payload")
        grouped = nodes.groupBy("g", "n", F.floor(F.col("rank") / trie.width).alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("items"))
        tables.append(cut(grouped.withColumn("tiers", trie.tiers(F.col("items.hash"), F.col("n"))), "trie"))
        up = tables[-1].select("g", F.ceil(F.col("n") / trie.width).alias("n"), F.col("chunk").alias("rank"), F.element_at(F.element_at("tiers", -1), 1).alias("hash"), F.lit(None).cast("string").alias("payload"))
        if up.filter("n > 1").isEmpty():
            return tables, up.select("g", "hash")
        nodes = up


def descend(tables: list[DataFrame], tops: DataFrame, trie: Trie) -> DataFrame:
    """(g, hash, payload, proof and the other columns of tops) of the lowest nodes; tops: g, proof and any more."""
    known = [c for c in tops.columns if c not in ("g", "proof")]
    now = tops.withColumn("chunk", F.lit(0).cast("long"))
    for table in reversed(tables):
        joined = table.join(now, ["g", "chunk"])
        below = F.transform("items", lambda x, i: F.struct(x["rank"].alias("chunk"), x["hash"].alias("hash"), x["payload"].alias("payload"), F.concat(trie.steps(F.col("tiers"), i), F.col("proof")).alias("proof")))
        now = joined.select("g", *known, below.alias("below")).select("g", *known, F.inline("below"))
        if table is not tables[0]:
            now = now.drop("hash", "payload")
    return now.drop("chunk")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, fanout: int = FANOUT, bucket_rows: int = BUCKET, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root, proof (before, after: the siblings, level by level), carried columns.

    Leaves of a group ascend by id (null first; rows that repeat an id by their leaves; equal rows in any order, as
    their leaves are equal); a null group is one of its own and the first, an empty text as group comes next. Null
    fields are `-`. Groups of any size are spread; very long texts are read once, for their hash. carry: expressions
    over docs by their names in the result. Ids are integers; an empty table gives no rows; other columns of docs,
    whatever their names, are not read.
    """
    trie = Trie(fanout, width)
    carry = carry or {}
    payload = F.struct(F.col(id_col).alias("id"), *[v.alias(f"c{k}") for k, v in enumerate(carry.values())])
    group = F.when(F.col(group_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    leaves = docs.select(group.alias("g"), F.col(id_col).cast("long").alias("id"), leaf_hash(*[F.col(c) for c in fields]).alias("hash"), F.monotonically_increasing_id().alias("row"), payload.alias("payload"))
    leaves = cut(leaves, "leaves")
    wide = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    number = F.coalesce(F.concat(F.lit("1"), wide(F.col("id").bitwiseXOR(F.lit(_LEAST_LONG)))), F.lit("0" * 17))
    ranked = radix_ranks(leaves, F.concat(number, F.col("hash"), wide(F.col("row"))), ["id", "hash", "row"], bucket_rows)
    tables, subroots = climb(ranked.select("g", "n", "rank", "hash", "payload"), trie)
    sources = cut(subroots.select(F.lit("").alias("g"), F.col("g").alias("payload"), "hash"), "subroots")
    over = radix_ranks(sources, F.hex("payload"), ["payload"], bucket_rows)
    above, top = climb(over.select("g", "n", "rank", "hash", "payload"), trie)
    no_steps = F.lit([]).cast("array<struct<before:string,after:string>>")
    tops = descend(above, top.select("g", F.col("hash").alias("root"), no_steps.alias("proof")), trie)
    tops = cut(tops.select(F.col("payload").alias("g"), F.col("hash").alias("subroot"), "root", "proof"), "tops")
    found = descend(tables, tops, trie)
    carried = [F.col(f"payload.c{k}").alias(name) for k, name in enumerate(carry)]
    return found.select(F.col("payload.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "proof", *carried)


def proof_hash(proof: Column) -> Column:
    """One hash of all siblings of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf leads to with the siblings of a proof."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))
