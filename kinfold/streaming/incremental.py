"""Incremental runs: batches after a high-water mark, or a file stream through the same batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.run_store import Conflict, RunStore


def after_mark(rows: DataFrame, stamp: str, mark) -> DataFrame:
    """Rows strictly after the mark (null: all). Late rows at or before it are never read again; reset the mark to read them."""
    return rows if mark is None else rows.filter(F.col(stamp) > F.lit(mark))


def advance(rows: DataFrame, stamp: str, mark):
    """The mark after a batch: its largest stamp, or the old mark if there is none."""
    got = rows.agg(F.max(stamp)).head()[0]
    return mark if got is None else got if mark is None else max(mark, got)


class Watermarks:
    """One mark for each (adapter, object), each write a whole new snapshot; advanced only after the batch succeeded."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, adapter: str, name: str) -> str | None:
        where, fs = self._fs(f"{self.path}/{adapter}/{name}")
        if not fs.exists(where):
            return None
        rows = self.spark.read.schema("epoch long, mark string").json(f"{self.path}/{adapter}/{name}")
        return rows.agg(F.max_by("mark", "epoch")).head()[0]

    def put(self, adapter: str, name: str, mark: str | None) -> None:
        place = f"{self.path}/{adapter}/{name}"
        where, fs = self._fs(place)
        last = self.spark.read.schema("epoch long, mark string").json(place).agg(F.max("epoch")).head()[0] if fs.exists(where) else 0
        self.spark.createDataFrame([((last or 0) + 1, mark)], "epoch long, mark string").write.mode("append").json(place)


    def reset(self, adapter: str, name: str, mark: str | None = None) -> None:
        """Goes back to an earlier mark, or (null) to the begin, so that late rows are read again."""
        self.put(adapter, name, mark)


def stream_files(spark: SparkSession, path: str, schema, apply: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 100, fmt: str = "parquet"):
    """Runs a batch function over files as they come; ends when what is there is done."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stream(store: RunStore, rows: DataFrame, name: str, checkpoint: str, publish: Callable[[DataFrame, str, int], None], tries: int = 5) -> int | None:
    """Calls publish(rows, stream, number) for each batch of a stream until what is there is done; gives the last number.

    publish makes a commit of the store under that stream and number. Rows and number become visible in one step, so a
    batch that failed, or that is sent again after the stream was killed, is there once. A checkpoint goes with its name:
    another one, which would read everything again, is refused. If another run is published meanwhile the batch is made
    again on top of it. None: there was no batch.
    """

    def apply(batch: DataFrame, number: int) -> None:
        ident = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        stream = f"{name}/{ident}"
        for left in reversed(range(tries)):
            others = [s for s in store.manifest()["streams"] if s.startswith(f"{name}/") and s != stream]
            if others:
                raise ValueError(f"{name!r} is filled by a stream with another checkpoint: {others}")
            try:
                publish(batch, stream, number)
                return
            except Conflict:
                if not left:
                    raise

    # Sources that can't bound a run do one batch a run, and after a failure that batch is the old one: run until none comes.
    before, number = -1, None
    while number != before:
        run = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        before, number = number, store.manifest()["streams"].get(f"{name}/{run.id}")
    return number


def append_stream(store: RunStore, rows: DataFrame, table: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, tries: int = 5) -> int | None:
    """Appends a stream's rows (after `change`) to a table of the store, each batch once; gives the last batch's number."""

    def publish(batch: DataFrame, stream: str, number: int) -> None:
        store.commit(stream, number, {}, {table: change(batch) if change else batch})

    return run_stream(store, rows, table, checkpoint, publish, tries)


def file_names(spark: SparkSession, folder: str, files_per_batch: int = 1, pattern: str = "*.csv") -> DataFrame:
    """A stream of the paths of files as they come, oldest first; their contents are not read."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return rows.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern).load(folder).select("path")
