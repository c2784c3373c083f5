"""A Python data source for the pages of finished CRM bulk jobs, in batch and as a stream; one task a page.

A job's folder holds job.json with its state and, from when it is done, its pages as CSV files that don't change any more.
The path is the folder of one job, or one whose sub-folders are jobs; it is read through pyarrow.fs, so it may be on a
mounted disk, HDFS (by libhdfs and the Hadoop configuration of each machine) or an object store.

    spark.dataSource.register(CrmPages)
    spark.read.format("crm_pages").schema("Id string, Name string").load("hdfs://host/jobs/17")
    spark.readStream.format("crm_pages").schema("Id string, Name string").load("hdfs://host/jobs")

The stream's offset counts the pages of each finished job. A batch takes every job that finished since the batch before;
what an interrupted batch had planned is planned again from the offsets in the stream's checkpoint. Jobs whose batch is
committed may be deleted from the folder; a planned page that is gone before is an error, not a loss.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# States of a job that has its pages, and of one that never will.
DONE, BROKEN = "JobComplete", ("Failed", "Aborted")
#: Longest text of one field, in characters.
LONGEST_FIELD = 2**31 - 1


class JobError(RuntimeError):
    """A job failed, is not done yet, or lost pages."""


class Page(InputPartition):
    def __init__(self, folder: str, path: str):
        self.folder, self.path = folder, path


class Folder:
    """The jobs under a path."""

    def __init__(self, path: str):
        self.path = path
        uri = path.replace("s3a://", "s3://", 1)
        self.files, self.root = fs.FileSystem.from_uri(uri)
        self.root = self.root.rstrip("/")

    def _names(self, at: str, kind: fs.FileType) -> list[str]:
        return sorted(i.base_name for i in self.files.get_file_info(fs.FileSelector(at)) if i.type == kind)

    def _at(self, job: str) -> str:
        return f"{self.root}/{job}" if job else self.root

    def jobs(self) -> dict[str, str | None]:
        """State by the name of a sub-folder, or by an empty name if the path is a job itself; folders without job.json are none."""
        inside = ["", *self._names(self.root, fs.FileType.Directory)]
        found = {}
        for job, info in zip(inside, self.files.get_file_info([f"{self._at(j)}/job.json" for j in inside]), strict=True):
            if info.type == fs.FileType.File:
                with self.files.open_input_stream(info.path) as f:
                    found[job] = json.loads(f.read()).get("state")
        return {"": found[""]} if "" in found else found

    def pages(self, job: str) -> list[str]:
        return [f"{self._at(job)}/{n}" for n in self._names(self._at(job), fs.FileType.File) if n.endswith(".csv")]

    def open(self, page: str) -> io.TextIOWrapper:
        return io.TextIOWrapper(self.files.open_input_stream(page), encoding="utf-8-sig", newline="")


def read_page(page: Page, names: list[str]) -> Iterator[tuple]:
    csv.field_size_limit(LONGEST_FIELD)
    with Folder(page.folder).open(page.path) as f:
        for row in csv.DictReader(f):
            yield tuple(row.get(n) or None for n in names)


class CrmPages(DataSource):
    """Text columns of all pages; columns that a page lacks are null, further ones are not read, empty fields are null.

    Option broken: "raise" (the default) stops at a failed or aborted job, "skip" leaves it out.
    """

    @classmethod
    def name(cls) -> str:
        return "crm_pages"

    def schema(self) -> str:
        folder = Folder(self.options["path"])
        first = next((p for j in folder.jobs() for p in folder.pages(j)), None)
        if first is None:
            raise JobError(f"{folder.path} has no pages: give a schema")
        with folder.open(first) as f:
            return ", ".join("`" + c.replace("`", "``") + "` string" for c in next(csv.reader(f)))

    def _skips(self) -> bool:
        how = self.options.get("broken", "raise")
        if how not in ("raise", "skip"):
            raise ValueError(f"broken: raise or skip, not {how!r}")
        return how == "skip"

    def reader(self, schema: StructType) -> CrmPagesReader:
        return CrmPagesReader(self.options["path"], schema, self._skips())

    def streamReader(self, schema: StructType) -> CrmPagesStream:
        return CrmPagesStream(self.options["path"], schema, self._skips())


class CrmPagesReader(DataSourceReader):
    """All pages of all jobs, every one of which must be done."""

    def __init__(self, path: str, schema: StructType, skips: bool):
        self.path, self.names, self.skips = path, schema.names, skips

    def partitions(self) -> list[Page]:
        folder = Folder(self.path)
        states = {j: s for j, s in folder.jobs().items() if not (self.skips and s in BROKEN)}
        for job, state in states.items():
            if state in BROKEN:
                raise JobError(f"job {job!r} ended as {state}")
            if state != DONE:
                raise JobError(f"job {job!r} is not done: {state}")
        return [Page(self.path, p) for j in states for p in folder.pages(j)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return read_page(partition, self.names)


class CrmPagesStream(DataSourceStreamReader):
    """The pages of jobs as they finish; jobs under way wait for a later batch."""

    def __init__(self, path: str, schema: StructType, skips: bool):
        self.path, self.names, self.skips = path, schema.names, skips

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        folder = Folder(self.path)
        states = folder.jobs()
        broken = {j: s for j, s in states.items() if s in BROKEN}
        if broken and not self.skips:
            raise JobError(f"jobs that ended without pages: {broken}")
        return {j: len(folder.pages(j)) for j, s in states.items() if s == DONE}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        folder, planned = Folder(self.path), []
        for job in sorted(set(end) - set(start)):
            pages = folder.pages(job)
            if len(pages) != end[job]:
                raise JobError(f"job {job!r} had {end[job]} pages, now {len(pages)}")
            planned += [Page(self.path, p) for p in pages]
        return planned

    def read(self, partition: Page) -> Iterator[tuple]:
        return read_page(partition, self.names)
