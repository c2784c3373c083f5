"""CRM objects as files or tables: the extraction filters, incremental by modification stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of records that extraction leaves in or out.
CONTACT_TYPES = ("Volunteer", "")
SKIPPED_ACCOUNT_TYPES = ("Household", "School District", "School")
SKIPPED_SESSION_STATUS, SKIPPED_SESSION_TYPE = "Draft", "Connector Session"
BATCH_ROWS = 5000
#: Columns that the filters of each object read.
COLUMNS = {
    "contacts": ("Id", "Type", "FirstName", "LastName", "Email", "Phone", "SystemModstamp", "LastModifiedDate"),
    "accounts": ("Id", "Name", "Type", "Description", "SystemModstamp", "LastModifiedDate"),
    "affiliations": ("Id", "Contact", "Organization", "Primary", "Status", "StartDate", "EndDate", "SystemModstamp"),
    "sessions": ("Id", "Name", "Session_Status", "Session_Type", "Start", "End", "SystemModstamp"),
}


def read_pages(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Dropped CSV pages of one object as text columns; columns that no page has are null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast("string").alias(c) for c in columns])


def since(stamp: Column, last: str | None) -> Column:
    """Strictly after the last stamp; rows at it or before are never read again."""
    return F.lit(True) if last is None else stamp.try_cast("timestamp") > F.lit(last).try_cast("timestamp")


def contacts(raw: DataFrame, last: str | None = None, limit: int | None = None, volunteers_only: bool = True) -> DataFrame:
    kind = F.col("Type").isNull() | F.col("Type").isin(*CONTACT_TYPES)
    out = raw.filter(since(F.col("SystemModstamp"), last) & (kind if volunteers_only else F.lit(True))).orderBy("SystemModstamp", "Id")
    return out if limit is None else out.limit(limit)


def accounts(raw: DataFrame, last: str | None = None, limit: int | None = None) -> DataFrame:
    """Accounts without households and schools, by name where there is one; a null type stays."""
    out = raw.filter((F.col("Type").isNull() | ~F.col("Type").isin(*SKIPPED_ACCOUNT_TYPES)) & since(F.col("SystemModstamp"), last)).orderBy(*[c for c in ("Name", "Id") if c in raw.columns])
    return out if limit is None else out.limit(limit)


def affiliations(raw: DataFrame, of_contacts: DataFrame, last: str | None = None, limit: int | None = None, volunteers_only: bool = True) -> DataFrame:
    """Affiliations, by their stamp, of contacts of the extracted types: the parent's filter by a semi join, without its own stamp."""
    kind = F.col("Type").isNull() | F.col("Type").isin(*CONTACT_TYPES)
    parents = of_contacts.filter(kind if volunteers_only else F.lit(True)).select(F.col("Id").alias("Contact"))
    out = raw.filter(since(F.col("SystemModstamp"), last)).join(parents, "Contact", "left_semi").orderBy(*[c for c in ("SystemModstamp", "Id") if c in raw.columns])
    return out if limit is None else out.limit(limit)


def sessions(raw: DataFrame, last: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions that are no drafts or connectors, the latest start first where there is one."""
    kept = raw.filter(
        ~F.col("Session_Status").eqNullSafe(F.lit(SKIPPED_SESSION_STATUS)) & ~F.col("Session_Type").eqNullSafe(F.lit(SKIPPED_SESSION_TYPE)) & since(F.col("SystemModstamp"), last)
    )
    out = kept.orderBy(F.desc_nulls_last("Start"), "Id") if "Start" in raw.columns else kept
    return out if limit is None else out.limit(limit)


def pages(rows: DataFrame, path: str, batch_rows: int = BATCH_ROWS) -> None:
    """Writes extracted rows as CSV pages of at most so many rows, as the CRM's bulk jobs give them."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", batch_rows).csv(path)
