"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules here: space, and tab to carriage return.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir.

    Only a local session without that setting (as in tests) gets a folder of its own; on a cluster the setting is a must.
    """
    global _own_dir
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        _own_dir = _own_dir or tempfile.mkdtemp(prefix="kinfold-")
        return f"file://{_own_dir}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_dir(spark)}/kinfold-{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that `cut` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/kinfold-" in file:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ddl(fields) -> str:
    """The fields as a schema text."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)


_held: tuple[tuple, object] | None = None


def held(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one tokenizer, tree or cache, with the key that it was made for.

    Worker processes serve the tasks of all stages in turn. What another stage left is dropped first, so that their
    sizes never add up.
    """
    global _held
    if _held is None or _held[0] != key:
        _held = None
        few_arenas()
        trim()
        _held = (key, make())
    return _held[1]


def few_arenas() -> None:
    """Keeps the C library from giving each thread of a tokenizer memory of its own that it never gives back."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-8, 2)  # M_ARENA_MAX


def trim() -> None:
    """Gives memory that is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim:
        malloc_trim(0)


def remainder(column: str, m: int) -> Column:
    """crc32 of the column as text, modulo m (null: counted as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


#: Bytes of texts that go to Python at once; Spark's 64 MB stand in the JVM, twice while a buffer grows, and in the worker, for every task of an executor.
BATCH_BYTES = 4 << 20
BATCH_LIMIT, SPARKS_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches end at BATCH_BYTES, unless it has been given a limit of its own."""
    if spark.conf.get(BATCH_LIMIT) == SPARKS_LIMIT:
        spark.conf.set(BATCH_LIMIT, f"{BATCH_BYTES}b")


def map_columns(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow over dicts of Python lists or Arrow arrays: fn gets {name: Arrow array} and yields {name: values}."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow = _arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches if b.num_rows)
        for out in fn(read):
            columns = [v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            del out, columns
        trim()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, fields)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def bounded(values: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) slices of a batch of texts with at most that many bytes each, or one text."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if total + n > most_bytes and i > begin:
            yield begin, i
            begin, total = i, 0
        total += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)
