"""The import of a file of people: stage, judge, promote, decide, load; each step a table of the run's folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.scalar import normalize_email, normalize_name, normalize_phone, present, record_key
from kinfold.operators import dq, load, match
from kinfold.operators.materialize import cut
from kinfold.sources.people_csv import read_people, stage_people
from kinfold.sources.run_store import RunStore
from kinfold.streaming.incremental import file_names, run_stream

FIELDS = ("first_name", "last_name", "middle_name", "preferred_name", "email", "phone_e164", "notes", "internal_notes")
CORE = "person_id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", email_verified boolean, source string"
EMAILS = "entity_id long, email string, is_primary boolean"
PHONES = "entity_id long, phone string, is_primary boolean"
ADDRESSES = "entity_id long, street string, city string, state_code string, postal_code string, country_code string"
CONTACTS = "entity_id long, first_name string, last_name string, birthdate date"
#: What an address and a birthdate are made of, where a file has it.
DETAILS = ("street", "city", "state_code", "postal_code", "country_code", "dob")
ID_MAP = "external_system string, external_id string, entity_id long, is_active boolean, first_seen_at timestamp, last_seen_at timestamp"


def name_key(first: Column, last: Column) -> Column:
    a, b = normalize_name(first), normalize_name(last)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b))


def core_keys(core: DataFrame, emails: DataFrame | None) -> DataFrame:
    """(person_id, mail, phone, name, last) of the core, and a row for each further address of a person."""
    own = core.select("person_id", F.lower(present("email")).alias("mail"), present("phone_e164").alias("phone"), name_key(F.col("first_name"), F.col("last_name")).alias("name"), normalize_name("last_name").alias("last"))
    if emails is None:
        return own
    none = F.lit(None).cast("string")
    return own.unionByName(emails.select(F.col("entity_id").alias("person_id"), F.lower("email").alias("mail"), none.alias("phone"), none.alias("name"), none.alias("last")))


def clean_rows(judged: DataFrame) -> DataFrame:
    """Promoted rows as they are loaded: their number, ids, fields and keys."""
    extra = {f: F.col(f) if f in judged.columns else F.lit(None).cast("string") for f in (*FIELDS, *DETAILS)}
    extra |= {"email": normalize_email("email"), "phone_e164": normalize_phone("phone")}
    return judged.select(
        F.col("sequence_number").alias("clean_id"), "external_system", "external_id", *[extra[f].alias(f) for f in (*FIELDS, *DETAILS)], extra["email"].alias("mail"), extra["phone_e164"].alias("phone"),
        name_key(F.col("first_name"), F.col("last_name")).alias("name"), normalize_name("last_name").alias("last"),
    )


def load_people(clean: DataFrame, core: DataFrame, id_map: DataFrame, seen_at: Column, emails: DataFrame | None = None, dry_run: bool = False) -> dict[str, DataFrame]:
    """loaded, summary, core, emails, id_map, change_log, skips and suggestions of loading clean rows, and the phones, addresses and contacts that it creates.

    Inserted people are in the core before the run's updates are applied, so later rows of the run update them; people
    that the id map knows but the core lost are made again under their ids. A dry run gives the summary and the
    decisions, and the tables as they were.
    """
    spark = clean.sparkSession
    emails = emails if emails is not None else spark.createDataFrame([], EMAILS)
    decided = cut(load.decide_loads(clean, core_keys(core, emails), id_map), "decided")
    if dry_run:
        return {"loaded": decided, "summary": load.load_summary(decided, True), "core": core, "emails": emails, "id_map": id_map}
    new = decided.filter("load_action = 'inserted'")
    rows = new.select(F.col("entity_id").alias("person_id"), *FIELDS, F.lit(False).alias("email_verified"), F.col("external_system").alias("source"))
    lost = decided.filter(F.col("load_action").isin("updated", "reactivated")).join(core.select(F.col("person_id").alias("entity_id")), "entity_id", "left_anti")
    again = lost.groupBy(F.col("entity_id").alias("person_id")).agg(F.min_by(F.struct(*FIELDS, F.lit(False).alias("email_verified"), F.col("external_system").alias("source")), "clean_id").alias("p")).select("person_id", "p.*")
    loaded, after, log = load.apply_updates(decided, core.unionByName(rows).unionByName(again), FIELDS)
    loaded = cut(loaded, "loaded")
    lacking = {c: F.lit(None).cast("string") for c in DETAILS if c not in new.columns}
    created = load.created_tables(new.withColumns({"phone": F.col("phone_e164"), **lacking}))
    mails = emails.unionByName(created["emails"])
    return {
        "loaded": loaded,
        "summary": load.load_summary(loaded),
        "core": cut(after, "core"),
        "emails": cut(mails.unionByName(load.added_emails(loaded, mails)), "emails"),
        "phones": created["phones"],
        "addresses": created["addresses"],
        "contacts": created["contacts"],
        "id_map": cut(load.new_id_map(loaded, id_map, seen_at), "id_map"),
        "change_log": log,
        "skips": load.skips(loaded),
        "suggestions": load.load_suggestions(loaded),
    }


def import_people(
    spark: SparkSession, path: str | list[str], run_id: int, core: DataFrame, id_map: DataFrame, seen_at: Column, source: str = "csv",
    emails: DataFrame | None = None, promoted: DataFrame | None = None, dry_run: bool = False,
) -> dict[str, DataFrame]:
    """The run's tables: staged, violations, clean, and those of load_people.

    promoted: (external_system, external_id) of rows that this run's clean layer holds already; they are not loaded again.
    """
    staged = cut(stage_people(read_people(spark, path), run_id, source), "staged")
    judged = cut(dq.judge(staged, dq.person_rules(), warnings_fail=dry_run), "judged")
    key = record_key(F.col("external_id"), F.col("source_record_id"), F.col("sequence_number"), F.lit(None))
    known = promoted if promoted is not None else staged.select("external_system", "external_id").limit(0)
    clean = clean_rows(dq.promote(judged, known, ["external_system", "external_id"], ["first_name", "last_name"]))
    return {"staged": staged, "violations": dq.violation_log(judged, key, "volunteer"), "clean": clean, **load_people(clean, core, id_map, seen_at, emails, dry_run)}


def people_details(core: DataFrame, emails: DataFrame, addresses: DataFrame, contacts: DataFrame) -> DataFrame:
    """The people of the core as match.features compares them: one address each, all their e-mail addresses."""
    one = addresses.groupBy(F.col("entity_id").alias("person_id")).agg(F.min(F.struct("street", "city", "postal_code")).alias("a")).select("person_id", "a.*")
    born = contacts.groupBy(F.col("entity_id").alias("person_id")).agg(F.min("birthdate").cast("string").alias("dob"))
    mails = emails.groupBy(F.col("entity_id").alias("person_id")).agg(F.collect_set("email").alias("more"))
    none = F.lit(None).cast("string")
    rows = core.join(one, "person_id", "left").join(born, "person_id", "left").join(mails, "person_id", "left")
    own = F.array_compact(F.array(F.lower(present("email"))))
    return rows.select("person_id", "first_name", "last_name", "dob", "street", "city", "postal_code", none.alias("employer"), none.alias("school"), F.array_union(own, F.coalesce("more", own)).alias("emails"), F.array_compact(F.array("phone_e164")).alias("phones"))


def import_candidates(loaded: DataFrame, people: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """match.generate_candidates of a run's rows against the people that were there before it; sure matches aren't compared."""
    sure = F.col("load_action").isin("updated", "reactivated", "deterministic_update", *load.NO_CHANGE.values())
    none = F.lit(None).cast("string")
    rows = loaded.select(F.col("clean_id").alias("row_id"), sure.alias("matched"), "first_name", "last_name", *[F.col(c) if c in loaded.columns else none.alias(c) for c in ("dob", "street", "city", "postal_code")], none.alias("employer"), none.alias("school"), F.array_compact(F.array("email")).alias("emails"), F.array_compact(F.array("phone_e164")).alias("phones"))
    return match.generate_candidates(rows, people, existing)


#: Tables that a run replaces, with what they are before the first one, and tables that it adds its rows to.
SNAPSHOTS = {"core": CORE, "emails": EMAILS, "id_map": ID_MAP}
CREATED = {"phones": PHONES, "addresses": ADDRESSES, "contacts": CONTACTS}
RUN_TABLES = ("staged", "violations", "clean", "loaded", "change_log", "skips", "suggestions", "candidates")


def import_run(store: RunStore, path: str | list[str], batch: int, seen_at: Column, source: str = "csv", stream: str = "people", marks: dict[str, str] | None = None) -> int:
    """Imports a file into the latest version of a store and publishes all its tables as the next one; gives the version.

    A batch that is there already is not run again. Core, e-mails and id map are replaced; phones, addresses and contacts
    of new people, and the run's own tables (with run_id, the batch), come on top. A run that fails anywhere leaves the
    store as it was.
    """
    start = store.manifest()
    if batch <= start["streams"].get(stream, -1):
        return start["version"]
    at = start["version"] or None
    old = {name: store.read(name, at, schema) for name, schema in {**SNAPSHOTS, **CREATED}.items()}
    run = import_people(store.spark, path, batch, old["core"], old["id_map"], seen_at, source, old["emails"])
    existing = store.spark.createDataFrame([], "row_id long, person_id long")
    run["candidates"], _ = import_candidates(run["loaded"], people_details(old["core"], old["emails"], old["addresses"], old["contacts"]), existing)
    stamped = {name: run[name].withColumn("run_id", F.lit(batch).cast("long")) for name in RUN_TABLES}
    return store.commit(stream, batch, {name: run[name] for name in SNAPSHOTS}, {**{name: run[name] for name in CREATED}, **stamped}, marks, start)


def import_stream(store: RunStore, folder: str, checkpoint: str, seen_at: Column, source: str = "csv", stream: str = "people", files_per_batch: int = 1) -> int | None:
    """Imports the files that come into a folder, each batch of them once, until all that are there are done.

    A batch is a run of its own (run_id is its number), decided against the tables as earlier batches left them, and all
    its tables, its number and what follows from it are published in one step: a batch that fails between any two writes,
    or is sent again, leaves what one run leaves. Files of one batch have the same header; by default a batch is one file.
    A file without rows is a run without rows. Gives the number of the last batch, None if there was none.
    """

    def publish(names: DataFrame, own: str, number: int) -> None:
        files = sorted(r["path"] for r in names.collect())  # at most files_per_batch
        import_run(store, files, number, seen_at, source, own, {"file": files[-1]} if files else None)

    return run_stream(store, file_names(store.spark, folder, files_per_batch), stream, checkpoint, publish)
