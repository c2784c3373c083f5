"""Sequence packing: shortest-pack-first over the length histogram.

Texts are tokenised and cut into pieces of at most `max_tokens` ids. Only the histogram of piece lengths (at most
`max_tokens` rows) comes to the driver. There, lengths are placed longest first: each goes to the shortest packs that
have room, a whole range of equal packs at a time, which updates the packing-pattern counts. The placements, ranges of
ranks within a length against ranges of sequences, are then joined back to the pieces by rank.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import bounded, cut, map_columns
from kinfold.llm.tokens import byte_bpe

MAX_TOKENS = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Rows that are ranked together within one length, at least and at most; between them an eighth of a task's even share.
LEAST_RANKED, MOST_RANKED = 256, 50_000


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, number, first sequence, offset): rank first + j goes to sequence first + j.

    Packs with the same fill that were made together are one range of sequences, so the work follows the number of
    different lengths and patterns, not that of the pieces.
    """
    placements: list[tuple[int, int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []  # a heap of (fill, first sequence, number): the shortest packs come first
    made = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left and packs and packs[0][0] + length <= max_tokens:
            fill, first, number = heapq.heappop(packs)
            used = min(number, left)
            placements.append((length, rank, used, first, fill))
            rank, left = rank + used, left - used
            if used < number:
                heapq.heappush(packs, (fill, first + used, number - used))
            if fill + length < max_tokens:
                heapq.heappush(packs, (fill + length, first, used))
        if left:
            placements.append((length, rank, left, made, 0))
            if length < max_tokens:
                heapq.heappush(packs, (length, made, left))
            made += left
    return placements


def cut_pieces(
    docs: DataFrame, id_col: str, text_col: str, tokenizer: str = TOKENIZER, max_tokens: int = MAX_TOKENS, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of the pieces of every text; the last one ends with end_id."""

    def pieces(batches: Iterator[dict]) -> Iterator[dict]:
        bpe, end = byte_bpe(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for a, b in bounded(batch["text"], 2 << 20):
                out: dict[str, list] = {n: [] for n in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for row, ids in enumerate(bpe.packed(batch["text"][a:b])):
                    ids += end
                    for at in range(0, len(ids), 4 * max_tokens):
                        piece = ids[at : at + 4 * max_tokens]
                        out["row"].append(row)
                        out["start"].append(at // 4)
                        out["length"].append(len(piece) // 4)
                        out["ids_crc32"].append(zlib.crc32(piece))
                        out["doc_tokens"].append(len(ids) // 4)
                        out["ids"].append(piece if with_ids else None)
                yield {"id": batch["id"][a:b].take(np.array(out.pop("row"))), **out}

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = map_columns(read, pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return made if with_ids else made.drop("ids")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    max_tokens: int = MAX_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, packed, if asked for).

    A null or empty text is the end id alone. Pieces are ranked within their length by id and start, so ties and
    repeated rows get places of their own. No documents give no pieces. Other columns of docs are not read.
    """
    pieces = cut(cut_pieces(docs, id_col, text_col, tokenizer, max_tokens, end_id, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = np.array(shortest_pack_first(histogram, max_tokens), dtype=np.int64).reshape(-1, 5)
    # Ranks within a length: each (length, salt) is ordered by itself, then shifted by the counts of the salts before.
    # Salts follow each length's own count; the histogram has at most max_tokens rows, so it is broadcast.
    share = sum(histogram.values()) // (8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked_rows = min(max(share, LEAST_RANKED), MOST_RANKED)
    salts = docs.sparkSession.createDataFrame([(n, -(-rows // ranked_rows)) for n, rows in sorted(histogram.items())], "length long, salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("id", "start"), "salts"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "start")) - 1
    ranked = salted.withColumn("within", within).join(shift, ["length", "salt"]).withColumn("rank", F.col("within") + F.col("shift"))
    # The placements depend on the histogram alone: at most max_tokens lengths and ranges of equal packs.
    key = placed[:, 0] * (1 << 44) + placed[:, 1]
    order = np.argsort(key, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((key[order], placed[order]))

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        keys, rows = shared.value
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            own = rows[np.searchsorted(keys, batch["length"].to_numpy() * (1 << 44) + rank, side="right") - 1]
            yield {**batch, "sequence_id": own[:, 3] + rank - own[:, 1], "offset": own[:, 4]}

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    types = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, {'ids binary, ' * with_ids}sequence_id long, offset long"
    return map_columns(ranked.select(*names, "rank"), place, types).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves, from pack(..., with_ids=True): sequence_id, n_tokens, ids (packed), segments.

    Each group has at most max_tokens ids, so it fits in any task. Segments name their document, which may be null or
    come more than once; no pieces give no sequences.
    """
    grouped = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "length", F.col(id_col).alias("id"), "start", "ids"))).alias("parts")
    )
    ids = F.aggregate("parts", F.lit(b""), lambda got, p: F.concat(got, p["ids"]))
    segments = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["id"].alias("id"), p["start"].alias("start")))
    return grouped.select("sequence_id", "n_tokens", ids.alias("ids"), segments.alias("segments"))
