"""CSV files of people: header contract, scan with gap-keeping sequence numbers, blank rows, staging rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions.scalar import checksum, first_present
from kinfold.operators.materialize import cut

# Canonical headers and the other names they go by; the first two in REQUIRED must be there.
HEADERS = {
    "external_system": ["source_system"],
    "external_id": ["source_id", "record_id"],
    "first_name": ["given_name", "first"],
    "last_name": ["surname", "last"],
    "middle_name": ["middle"],
    "preferred_name": ["nickname", "preferred"],
    "email": ["email_address", "primary_email"],
    "alternate_emails": ["alt_emails", "secondary_emails"],
    "phone": ["phone_number", "primary_phone", "mobile"],
    "alternate_phones": ["alt_phones", "secondary_phones"],
    "dob": ["date_of_birth", "birthdate"],
    "gender": [],
    "race_ethnicity": ["race", "ethnicity"],
    "street": ["address", "address_line1"],
    "street2": ["address_line2", "apt"],
    "city": [],
    "state_code": ["state", "region"],
    "postal_code": ["zip", "zip_code"],
    "country_code": ["country"],
    "employer": [],
    "notes": ["volunteer_notes", "public_notes"],
    "school_affiliation": ["school", "school_name"],
    "student_flag": ["is_student"],
    "consent_signed_at": ["consent_date", "consent_timestamp"],
    "background_check_status": ["bgc_status", "background_status"],
    "background_check_date": ["bgc_date", "background_date"],
    "photo_release": ["photo_consent"],
    "source_updated_at": ["last_modified", "updated_at"],
    "ingested_at": [],
    "ingest_version": ["contract_version"],
}
REQUIRED = ("first_name", "last_name")


class HeaderError(ValueError):
    """The header row breaks the contract."""


def header_token(header: str) -> str:
    """A header as it is compared: no BOM, trimmed, lower case, underscores."""
    return header.removeprefix("﻿").strip().lower().translate(str.maketrans(" -.", "___"))


def aliases() -> dict[str, str]:
    return {header_token(a): name for name, more in HEADERS.items() for a in (name, *more)}


def resolve_headers(raw: list[str]) -> list[str]:
    """Canonical names of a header row; missing, unknown and doubled headers are errors."""
    known = aliases()
    tokens = [header_token(h) for h in raw]
    unknown = [h for h, t in zip(raw, tokens, strict=True) if t not in known]
    if unknown:
        raise HeaderError(f"unexpected headers: {unknown}")
    names = [known[t] for t in tokens]
    double = sorted({n for n in names if names.count(n) > 1})
    missing = [n for n in REQUIRED if n not in names]
    if double or missing:
        raise HeaderError(f"doubled headers: {double}; missing headers: {missing}")
    return names


def is_blank(names: list[str]) -> Column:
    blank = F.lit(True)
    for n in names:
        blank = blank & (F.coalesce(F.trim(F.col(n)), F.lit("")) == "")
    return blank


def canonical(rows: DataFrame) -> DataFrame:
    """Columns under their canonical names, trimmed; unknown ones are dropped, and of two names for one field the first stays."""
    known, taken = aliases(), {}
    for c in rows.columns:
        name = known.get(header_token(c))
        if name is not None:
            taken.setdefault(name, c)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(n) for n, c in taken.items()])


def missing_headers(columns: list[str]) -> list[str]:
    """Required fields that no column stands for."""
    there = {aliases().get(header_token(c)) for c in columns}
    return [n for n in REQUIRED if n not in there]


def read_people(spark: SparkSession, path: str | list[str], skip_blank: bool = True) -> DataFrame:
    """sequence_number and the canonical columns as trimmed text.

    Rows are numbered from 1 before blank ones go, so gaps remain: in a file by their place, which needs no shuffle, and
    over the files of a folder in the order of their names. Multi-line files are read whole, one task each, so a large
    export should come as many files.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = resolve_headers(raw.columns)
    file = raw.select(F.col("_metadata.file_path").alias("_file"), *[F.trim(F.col(f"`{c}`")).alias(n) for c, n in zip(raw.columns, names, strict=True)])
    placed = file.withColumn("sequence_number", F.monotonically_increasing_id() + 1)
    if len(raw.inputFiles()) > 1:
        placed = cut(placed, "csv")
        files = placed.groupBy("_file").agg(F.min("sequence_number").alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
        placed = placed.join(F.broadcast(files.select("_file", "_first", before.alias("_before"))), "_file").withColumn("sequence_number", F.col("sequence_number") - F.col("_first") + F.col("_before") + 1)
    numbered = placed.select("sequence_number", *names)
    return numbered.filter(~is_blank(names)) if skip_blank else numbered


def scan_counts(rows: DataFrame) -> DataFrame:
    """rows_read, rows_skipped_blank and rows_kept, from rows that were read with their blank ones."""
    blank = is_blank([c for c in rows.columns if c != "sequence_number"])
    return rows.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(blank).alias("rows_skipped_blank"), F.count_if(~blank).alias("rows_kept"))


def column_population(rows: DataFrame, names: list[str]) -> DataFrame:
    """(field, populated, population_rate) in one pass; white space alone counts as a value."""
    aggs = [F.count(F.when(F.coalesce(F.col(n), F.lit("")) != "", 1)).alias(n) for n in names]
    one = rows.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("populated")) for n in names])).alias("p")
    return one.select("_n", pairs).select("p.field", "p.populated", F.round(F.coalesce(F.try_divide(F.col("p.populated"), F.col("_n")), F.lit(0.0)), 4).alias("population_rate"))


def stage_people(rows: DataFrame, run_id: int, source_system: str) -> DataFrame:
    """Landed staging rows: envelope columns, the canonical fields, and a checksum of what was read."""
    names = [c for c in rows.columns if c != "sequence_number"]
    col = lambda n: F.col(n) if n in names else F.lit(None).cast("string")
    return rows.select(
        F.lit(run_id).cast("long").alias("run_id"),
        "sequence_number",
        first_present(col("external_id"), col("email"), col("phone")).alias("source_record_id"),
        F.coalesce(first_present(col("external_system")), F.lit(source_system)).alias("external_system"),
        *[col(n).alias(n) for n in HEADERS if n != "external_system"],
        checksum({n: F.col(n) for n in names}).alias("checksum"),
        F.lit("landed").alias("status"),
    )


def _crm(object_name: str):
    """A reader of dropped pages of one CRM object; the columns are those that extraction needs."""

    def read(spark: SparkSession, path: str) -> DataFrame:
        from kinfold.sources import crm

        return crm.read_pages(spark, path, list(crm.COLUMNS[object_name]))

    return read


def _later(spark: SparkSession, path: str) -> DataFrame:
    raise NotImplementedError("sheets are a placeholder: export them as CSV")


READERS = {"csv": read_people, **{f"crm_{n}": _crm(n) for n in ("contacts", "accounts", "affiliations", "sessions")}, "sheets": _later}


def reader(name: str):
    if name not in READERS:
        raise KeyError(f"no source named {name!r}; there are {sorted(READERS)}")
    return READERS[name]
