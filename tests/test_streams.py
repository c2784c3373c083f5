"""CRM pages and first-wins decisions as streams: restarts, splits into batches, late rows."""

import json
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from kinfold.sources import crm_pages
from kinfold.sources.run_store import RunStore
from kinfold.streaming import first_wins, incremental

SCHEMA = "Id string, Name string"


def job(root, name, state="JobComplete", pages=3, rows=5):
    folder = root / name
    folder.mkdir(parents=True, exist_ok=True)
    for p in range(pages):
        (folder / f"{p:04d}.csv").write_text("Id,Name\n" + "".join(f'{name}-{p}-{r},"line\n{r}, x"\n' for r in range(rows)))
    (folder / "job.json").write_text(json.dumps({"state": state}))


def ids(frame):
    return sorted(map(tuple, frame.select("Id", "Name").collect()), key=str)


def test_stream_reads_finished_jobs_once(spark, tmp_path):
    spark.dataSource.register(crm_pages.CrmPages)
    root, store = tmp_path / "jobs", RunStore(spark, str(tmp_path / "store"))
    job(root, "a")
    job(root, "b", "InProgress")
    (root / "no job").mkdir()

    def pull():
        rows = spark.readStream.format("crm_pages").schema(SCHEMA).load(str(root))
        incremental.append_stream(store, rows, "contacts", str(tmp_path / "state"))

    pull()
    assert {r[0].split("-")[0] for r in ids(store.read("contacts"))} == {"a"}
    pull()  # nothing new
    assert store.read("contacts").count() == 15
    job(root, "b")
    job(root, "c", pages=1)
    pull()
    batch = spark.read.format("crm_pages").schema(SCHEMA).load(str(root))
    assert ids(store.read("contacts")) == ids(batch) and batch.count() == 35 and batch.rdd.getNumPartitions() == 7
    with pytest.raises(Exception, match="another checkpoint"):
        rows = spark.readStream.format("crm_pages").schema(SCHEMA).load(str(root))
        incremental.append_stream(store, rows, "contacts", str(tmp_path / "other"))
    job(root, "d", "Failed", pages=0)
    with pytest.raises(Exception, match="ended without pages"):
        pull()
    rows = spark.readStream.format("crm_pages").option("broken", "skip").schema(SCHEMA).load(str(root))
    incremental.append_stream(store, rows, "contacts", str(tmp_path / "state"))
    assert store.read("contacts").count() == 35
    with pytest.raises(Exception, match="Failed"):
        spark.read.format("crm_pages").schema(SCHEMA).load(str(root)).count()


def test_long_fields_and_lost_pages(spark, tmp_path):
    spark.dataSource.register(crm_pages.CrmPages)
    job(tmp_path / "jobs", "a", pages=1)
    (tmp_path / "jobs" / "a" / "0001.csv").write_text("Id,Name\nlong," + "x" * 300_000 + "\n")
    rows = spark.read.format("crm_pages").schema(SCHEMA).load(str(tmp_path / "jobs"))
    assert rows.filter("Id = 'long'").select(F.length("Name")).head()[0] == 300_000
    stream = crm_pages.CrmPagesStream(str(tmp_path / "jobs"), rows.schema, False)
    end = stream.latestOffset()
    assert end == {"a": 2} and len(stream.partitions({}, end)) == 2 and stream.partitions(end, end) == []
    (tmp_path / "jobs" / "a" / "0001.csv").unlink()
    with pytest.raises(crm_pages.JobError, match="had 2 pages, now 1"):
        stream.partitions({}, end)


def test_killed_stream_is_restarted(spark, tmp_path):
    """The process dies once before and once after a batch's tables are published; each page is there once."""
    root, store = tmp_path / "jobs", RunStore(spark, str(tmp_path / "store"))
    job(root, "a")
    code = f"""
        import os, sys
        from pyspark.sql import SparkSession
        from kinfold.sources import crm_pages
        from kinfold.sources.run_store import RunStore
        from kinfold.streaming import incremental
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        spark.dataSource.register(crm_pages.CrmPages)
        publish = RunStore._publish
        def die(self, manifest):
            if sys.argv[1] == "after":
                publish(self, manifest)
            os.kill(spark.sparkContext._gateway.proc.pid, 9)
            os._exit(9)
        RunStore._publish = die
        rows = spark.readStream.format("crm_pages").schema("{SCHEMA}").load({str(root)!r})
        incremental.append_stream(RunStore(spark, {str(tmp_path / "store")!r}), rows, "contacts", {str(tmp_path / "state")!r})
    """
    for when, there in (("before", 0), ("after", 1)):
        done = subprocess.run([sys.executable, "-c", textwrap.dedent(code), when], cwd=incremental.__file__.rsplit("/", 3)[0], timeout=180, capture_output=True, check=False)
        assert done.returncode == 9, done.stderr[-2000:]
        assert len(store.versions()) == there
    job(root, "b")
    spark.dataSource.register(crm_pages.CrmPages)
    rows = spark.readStream.format("crm_pages").schema(SCHEMA).load(str(root))
    incremental.append_stream(store, rows, "contacts", str(tmp_path / "state"))
    assert ids(store.read("contacts")) == ids(spark.read.format("crm_pages").schema(SCHEMA).load(str(root)))


ROWS = "k string, v string, seq long, run timestamp"


def decided(spark, tmp_path, tag, batches, lateness="1 hour"):
    """Streams one file a batch and gives the decisions and the late rows."""
    source, out = tmp_path / f"{tag}-in", tmp_path / f"{tag}-out"
    first_wins.keep_state(spark)
    late = 0
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(source / f"b{i:03d}"))
        read = spark.readStream.schema(ROWS).load(str(source / "b*"))
        made = first_wins.decide_stream(read, ["k", "v"], "seq", "run", lateness)
        q = made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{tag}-state")).format("parquet").trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        late += first_wins.late_rows(q)
    return sorted(map(tuple, spark.read.parquet(str(out)).collect()), key=str), late


def plain(rows):
    least = {}
    for k, v, seq, run in rows:
        if None not in (k, v, run):
            least[k, v, run] = min(seq, least.get((k, v, run), seq))
    out = []
    for k, v, seq, run in rows:
        d = "unkeyed" if None in (k, v) else "undated" if run is None else "first" if least[k, v, run] == seq else "duplicate"
        out.append((k, v, seq, run, d))
    return sorted(out, key=str)


def made_rows(n):
    import datetime

    rng = random.Random(5)
    runs = [datetime.datetime(2024, 1, 1, 12), datetime.datetime(2024, 1, 1, 12, 30)]
    return [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice(["x", "y"]), i, None if rng.random() < 0.05 else rng.choice(runs)) for i in range(n)]


def test_any_split_gives_the_same_decisions(spark, tmp_path):
    rows = made_rows(60)
    want = plain(rows)
    table = spark.createDataFrame(rows, ROWS)
    assert sorted(map(tuple, first_wins.decide(table, ["k", "v"], "seq", "run").collect()), key=str) == want
    for tag, cuts in (("whole", []), ("three", [1, 40])):
        ends = [0, *cuts, len(rows)]
        got, late = decided(spark, tmp_path, tag, [rows[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        assert got == want and late == 0


def test_state_is_forgotten_and_late_rows_are_counted(spark, tmp_path):
    import datetime

    early, later = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    got, late = decided(spark, tmp_path, "late", [[("a", "x", 1, early)], [("a", "x", 2, later)], [("a", "x", 3, early), ("a", "x", 4, later)]])
    assert [(r[2], r[4]) for r in sorted(got, key=lambda r: r[2])] == [(1, "first"), (2, "first"), (4, "duplicate")] and late == 1


def test_decisions_of_an_empty_table(spark):
    assert first_wins.decide(spark.createDataFrame([], ROWS), ["k", "v"], "seq", "run").count() == 0
