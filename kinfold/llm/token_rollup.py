"""Token counts as delta-maintained rollups.

A batch of changes (inserts, deletes, revised counts) is turned into signed deltas against what the ledger holds of
the touched documents, and only these deltas are added to the totals by source, language and tokenizer version. A
commit marker, written last, names the batch: a repeated batch changes nothing, and one that was broken off is written
again from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import bounded, map_columns
from kinfold.llm.tokens import byte_bpe

TOKENIZER = "byte_bpe_50k.json"
GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id string, tokenizer string, source string, lang string, n_tokens long, live boolean"
#: After so many batches the ledger is written anew as one table, so that reading it follows its size and not its history.
COMPACT_EVERY = 8
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source", "lang"), tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row of docs: id, the kept columns as text, n_tokens of the whole text (null and empty: 0).

    Rows that repeat an id are counted each by itself; an empty table gives no rows; no other column of docs is read.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for a, b in bounded(batch["text"]):
                yield {"id": batch["id"][a:b], **{f"k{i}": batch[f"k{i}"][a:b] for i in range(len(keep))}, "n_tokens": bpe.counts(batch["text"][a:b])}

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(keep)])
    done = map_columns(read, run, f"id {kind}, {''.join(f'k{i} string, ' for i in range(len(keep)))}n_tokens long")
    return done.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")


def same(a: str, b: str, columns: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


class TokenRollup:
    """Totals and a ledger of documents under a folder that all executors share.

    ledger/epoch=N holds what batch N changed (the latest epoch of a key holds), totals/epoch=N the totals after it,
    snapshot/epoch=N, every few batches, the live documents after it, and commits/N-<batch> says that all are whole.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> dict[str, int]:
        """Epochs of the batches that are whole."""
        folder = self._path(f"{self.path}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return {n.split("-", 1)[1]: int(n.split("-", 1)[0]) for n in names if not n.startswith(("_", "."))}

    def _base(self, last: int) -> int:
        """The latest snapshot of a committed epoch, or 0."""
        folder = self._path(f"{self.path}/snapshot")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((e for n in names if n.startswith("epoch=") and (e := int(n[6:])) <= last), default=0)

    def _rows(self, epochs: list[int], base: int) -> DataFrame:
        """The rows that decide what the ledger holds, with their epochs: those of a snapshot and of the epochs after it."""
        read = self.spark.read.schema(LEDGER + ", epoch int")
        later = [f"{self.path}/ledger/epoch={e}" for e in epochs if e > base]
        rows = read.option("basePath", f"{self.path}/snapshot").parquet(f"{self.path}/snapshot/epoch={base}") if base else None
        if later:
            more = read.option("basePath", f"{self.path}/ledger").parquet(*later)
            rows = rows.unionByName(more) if rows is not None else more
        return rows

    def ledger(self, keys: DataFrame | None = None) -> DataFrame:
        """What the committed batches left of each document and tokenizer version (of those keys alone, if given), deleted ones included."""
        epochs = sorted(self.commits().values())
        if not epochs:
            return self.spark.createDataFrame([], LEDGER)
        rows = self._rows(epochs, self._base(epochs[-1]))
        if keys is not None:
            rows = rows.alias("o").join(keys.alias("n"), same("o", "n", ("doc_id", "tokenizer")), "left_semi")
        last = F.max_by(F.struct("source", "lang", "n_tokens", "live"), "epoch").alias("s")
        return rows.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "s.*")

    def totals(self) -> DataFrame:
        """n_docs and n_tokens of the live documents by source, language and tokenizer version."""
        epochs = self.commits().values()
        if not epochs:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/totals/epoch={max(epochs)}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes (op, seq, doc_id, tokenizer, source, lang, n_tokens); False if the batch was committed before.

        op is insert, revise or delete. Inserts of documents that are there count as revisions, deletes and revisions
        of missing ones as nothing and as inserts. Of several changes of one key the largest seq holds; ties go to
        the largest values. Ids of any type are kept as text. Rows with a null doc_id or another op change nothing; null
        counts are 0; an empty batch is committed and changes nothing. Columns beyond these are not read.
        """
        done = self.commits()
        batch = "".join(c if c.isalnum() or c in "_." else f"%{ord(c):x}" for c in batch)
        if batch in done:
            return False
        epoch = max(done.values(), default=0) + 1
        state = F.struct("seq", F.struct("source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), (F.col("op") != "delete").alias("live")).alias("s"))
        new = (
            changes.filter(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "revise", "delete"))
            .groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("tokenizer").cast("string").alias("tokenizer"))
            .agg(F.max(state).alias("m"))
            .select("doc_id", "tokenizer", "m.s.*")
        )
        place = f"{self.path}/ledger/epoch={epoch}"
        new.write.mode("overwrite").parquet(place)
        new = self.spark.read.schema(LEDGER).parquet(place)
        plus = new.filter("live").select(*GROUP, F.lit(1).alias("n_docs"), "n_tokens")
        deltas = plus
        if done:
            old = self.ledger(new).filter("live")
            deltas = plus.unionByName(old.select(*GROUP, F.lit(-1).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        added = self.totals().unionByName(deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
        summed = added.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")
        summed.write.mode("overwrite").parquet(f"{self.path}/totals/epoch={epoch}")
        if done and epoch - self._base(epoch - 1) >= COMPACT_EVERY:
            self._compact([*sorted(done.values()), epoch])
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        marker, final = self._path(f"{self.path}/commits/.{epoch}"), self._path(f"{self.path}/commits/{epoch}-{batch}")
        self._fs.create(marker, True).close()
        if not self._fs.rename(marker, final):
            raise RuntimeError(f"batch {batch} could not be committed")
        return True

    def _compact(self, epochs: list[int]) -> None:
        """Writes the live documents after the last of these epochs, which the commit that follows makes valid."""
        last = F.max_by(F.struct("source", "lang", "n_tokens", "live"), "epoch").alias("s")
        whole = self._rows(epochs, self._base(epochs[-1] - 1)).groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", "s.*").filter("live")
        whole.write.mode("overwrite").parquet(f"{self.path}/snapshot/epoch={epochs[-1]}")
