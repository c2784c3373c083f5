"""Idempotent loading of clean people into the core: one decision for each row, then the tables that follow from it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.scalar import parse_birthdate, present
from kinfold.operators.alike import alike_names
from kinfold.operators.components import components
from kinfold.operators.materialize import cut, scratch_path
from kinfold.operators.ranking import number_within

#: Kinds of keys by which a row can meet an earlier one.
KINDS = ("mail", "phone", "name")


#: Names this alike count as the same person while loading.
NEAR_NAME = 0.95
#: Rounds over all rows before what is left is decided by components, and the rows of a component that one task takes.
ROUNDS, LARGEST = 2, 200_000
NO_CHANGE = {"updated": "skipped_no_change", "deterministic_update": "deterministic_no_change"}


def _keys(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, kind, value) of all keys that are there."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KINDS])
    return rows.select(ident, F.explode(pairs).alias("k")).select(ident, "k.*").filter("value is not null")


def near_names(clean: DataFrame, core: DataFrame, least: float = NEAR_NAME) -> DataFrame:
    """(name, near): different names of both sides alike enough, of one last name and first initial.

    Pairs come from a join with filters (operators/alike.py); of names that only the core has none are compared with
    each other. Without a column `last` on both sides there are none.
    """
    if "last" not in clean.columns or "last" not in core.columns:
        return clean.select("name", F.col("name").alias("near")).limit(0)
    both = clean.select("name", "last", F.lit(True).alias("wanted")).unionByName(core.select("name", "last", F.lit(False).alias("wanted")))
    pairs = alike_names(both, least).select(F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("near")), F.struct(F.col("b").alias("name"), F.col("a").alias("near"))).alias("p"))
    turned = pairs.select(F.explode("p").alias("p")).select("p.*")
    return turned.join(clean.select("name").distinct(), "name", "left_semi").distinct()


def _met(probes: DataFrame, core_keys: DataFrame) -> DataFrame:
    """What each row meets: (clean_id, n_mail, n_phone, n_both, both_id, contact_id, mail_id, name_id, near_id) of probes in core_keys.

    The counts are 0, 1 or 2 (several), from the least and the largest person of each key and of each pair of address and
    number; no row is joined with all persons that share its key.
    """
    ends = [F.min("person_id").alias("lo"), F.max("person_id").alias("hi")]
    held = probes.join(core_keys.groupBy("kind", "value").agg(*ends), ["kind", "value"])
    of = lambda kind, c, how: how(F.when(F.col("as_kind") == kind, F.col(c)))
    least = {"mail": "mail_id", "phone": "phone_id", "name": "name_id", "fuzzy": "near_id"}
    found = held.groupBy("clean_id").agg(*[of(k, "lo", F.min).alias(c) for k, c in least.items()], *[of(k, "hi", F.max).alias(f"{k}_hi") for k in ("mail", "phone")], *[of(k, "value", F.max).alias(k) for k in ("mail", "phone")])
    own = lambda kind: core_keys.filter(F.col("kind") == kind).select("person_id", F.col("value").alias(kind)).distinct()
    both = own("mail").join(own("phone"), "person_id").groupBy("mail", "phone").agg(F.min("person_id").alias("both_id"), F.max("person_id").alias("both_hi"))
    some = lambda lo, hi: F.when(F.col(lo).isNull(), 0).when(F.col(lo) == F.col(hi), 1).otherwise(2).cast("long")
    return found.join(both, ["mail", "phone"], "left").select(
        "clean_id", some("mail_id", "mail_hi").alias("n_mail"), some("phone_id", "phone_hi").alias("n_phone"), some("both_id", "both_hi").alias("n_both"),
        "both_id", F.least("mail_id", "phone_id").alias("contact_id"), "mail_id", "name_id", "near_id",
    )


def _settle(ready: DataFrame, core_keys: DataFrame, probes: DataFrame) -> DataFrame:
    """The decision of rows whose keys no undecided earlier row can change any more."""
    found = _met(probes.join(ready.select("clean_id"), "clean_id", "left_semi"), core_keys)
    done = ready.join(found, "clean_id", "left").fillna(0, ["n_mail", "n_phone", "n_both"])
    one = ((F.col("n_phone") == 0) & (F.col("n_mail") == 1)) | ((F.col("n_mail") == 0) & (F.col("n_phone") == 1))
    match = F.when(F.col("n_both") == 1, F.col("both_id")).when((F.col("n_both") == 0) & one, F.col("contact_id"))
    ambiguous = match.isNull() & (F.col("n_mail") + F.col("n_phone") > 0)
    first = lambda hit, mail, name, near, other: F.when(match.isNotNull(), hit).when(F.col("n_mail") > 0, mail).when(F.col("name_id").isNotNull(), name).when(F.col("near_id").isNotNull(), near).otherwise(other)
    none = F.lit(None)
    action = first(F.lit("deterministic_update"), F.lit("skipped_duplicate"), F.lit("skipped_duplicate"), F.lit("skipped_duplicate_fuzzy"), F.lit("inserted"))
    reason = first(none, F.lit("DUPLICATE_EMAIL"), F.lit("DUPLICATE_NAME"), F.lit("DUPLICATE_FUZZY"), none)
    entity = first(match, F.col("mail_id"), F.col("name_id"), F.col("near_id"), none)
    return done.select(*ready.columns, action.alias("load_action"), reason.cast("string").alias("skip_reason"), entity.alias("entity_id"), ambiguous.alias("ambiguous"))


def _free(probes: DataFrame, waiting: DataFrame, core_keys: DataFrame) -> DataFrame:
    """Probes of waiting rows at keys that nobody holds so far."""
    here = probes.join(waiting.select("clean_id"), "clean_id", "left_semi")
    return here.join(core_keys.select("kind", "value").distinct(), ["kind", "value"], "left_anti")


class _Group:
    """What the earlier rows of one group have added: the holder of each free address and name, the number of holders of each number."""

    def __init__(self) -> None:
        self.mail: dict[str, int] = {}
        self.name: dict[str, int] = {}
        self.phones: Counter[str] = Counter()
        self.first: dict[str, int] = {}
        self.own: dict[int, str | None] = {}

    def decide(self, r: dict, base: int) -> tuple[str, str | None, int | None, bool]:
        """(action, reason, entity, ambiguous) of the next row, in the order of clean_id."""
        holder = self.mail.get(r["mail"]) if r["mail"] is not None else None
        phones = r["n_phone"] + (self.phones[r["phone"]] if r["phone"] is not None else 0)
        mails, shared = r["n_mail"] + (holder is not None), r["n_both"]
        match = None
        if holder is not None:  # an address that the core lacks has one holder at most
            has_phone = r["phone"] is not None and (self.own.get(holder) == r["phone"] or holder in r["also"])
            shared = int(has_phone)
            if shared:
                match = holder
        elif shared == 1:
            match = r["both_id"]
        if shared == 0 and mails + phones == 1:
            match = holder if holder is not None else r["contact_id"] if r["contact_id"] is not None else self.first.get(r["phone"])
        ambiguous = match is None and mails + phones > 0
        if match is not None:
            return "deterministic_update", None, match, False
        if mails:
            return "skipped_duplicate", "DUPLICATE_EMAIL", holder if holder is not None else r["mail_id"], ambiguous
        named = r["name_id"] if r["name_id"] is not None else self.name.get(r["name"])
        if named is not None:
            if r["mail"] is not None:
                self.mail[r["mail"]] = named
            return "skipped_duplicate", "DUPLICATE_NAME", named, ambiguous
        near = [p for p in (r["near_id"], *(self.name.get(n) for n in r["near"])) if p is not None]
        if near:
            return "skipped_duplicate_fuzzy", "DUPLICATE_FUZZY", min(near), ambiguous
        new = base + r["clean_id"]
        self.own[new] = r["phone"]
        if r["mail"] is not None:
            self.mail[r["mail"]] = new
        if r["name"] is not None:
            self.name[r["name"]] = new
        if r["phone"] is not None:
            self.phones[r["phone"]] += 1
            self.first.setdefault(r["phone"], new)
        return "inserted", None, new, ambiguous


def _fold(waiting: DataFrame, groups: DataFrame, core_keys: DataFrame, probes: DataFrame, base: int) -> DataFrame:
    """(clean_id, load_action, skip_reason, entity_id, ambiguous) of whole groups of rows, each group in order by one task.

    groups: clean_id, group. What a row meets in the core comes as counts and least ids. The only persons of the core
    whose addresses can change on the way are the first of a known name; `also` has those of them in the row's group that
    hold the row's number.
    """
    rows = waiting.select("clean_id", *KINDS).join(groups, "clean_id")
    met = _met(probes.join(groups.select("clean_id"), "clean_id", "left_semi"), core_keys)
    named = met.filter("name_id is not null").join(groups, "clean_id").select("group", F.col("name_id").alias("person_id")).distinct()
    numbers = named.join(core_keys.filter("kind = 'phone'"), "person_id").select("group", "value", "person_id")
    also = probes.filter("as_kind = 'phone'").join(groups, "clean_id").join(numbers, ["group", "value"]).groupBy("clean_id").agg(F.collect_set("person_id").alias("also"))
    near = probes.filter("as_kind = 'fuzzy'").join(groups.select("clean_id"), "clean_id", "left_semi").groupBy("clean_id").agg(F.collect_set("value").alias("near"))
    counts, ids = ["n_mail", "n_phone", "n_both"], ["both_id", "contact_id", "mail_id", "name_id", "near_id"]
    given = rows.join(met, "clean_id", "left").join(also, "clean_id", "left").join(near, "clean_id", "left")
    given = given.select("group", "clean_id", *KINDS, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], *ids, F.coalesce("also", F.array().cast("array<long>")).alias("also"), F.coalesce("near", F.array().cast("array<string>")).alias("near"))
    schema = "clean_id long, load_action string, skip_reason string, entity_id long, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, _Group()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["group"] != now:
                    now, state = r["group"], _Group()
                out.append((r["clean_id"], *state.decide(r, base)))
            if out:
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    return given.repartition("group").sortWithinPartitions("group", "clean_id").mapInArrow(run, schema)


def decide_loads(clean: DataFrame, core: DataFrame, id_map: DataFrame, least_near: float = NEAR_NAME, rounds: int = ROUNDS, largest: int = LARGEST) -> DataFrame:
    """clean with load_action, skip_reason, entity_id and ambiguous.

    clean: clean_id, external_system, external_id, mail, phone, name (normalised) and, for similar names, last. core:
    person_id, mail, phone, name, last. id_map: external_system, external_id, entity_id, is_active. Rows are taken in
    the order of clean_id and see what earlier rows of the run inserted or added to a person of the same name. Inserted
    rows get entity ids after the core's largest, by clean_id; two loads into one core must not run at a time.

    First rounds over all rows: a row is decided once each of its keys is in the core (then no later row can be inserted
    under it) or is held by no undecided earlier row; so a key of any number of rows is settled by two rounds. What is
    left hangs together by chains of different keys. Its rows are grouped into components by the keys that nobody holds,
    and each component of `largest` rows at most is decided in order by one task, all of them in one pass. Larger ones go
    on by rounds, a link of a chain each, without a limit.
    """
    spark = clean.sparkSession
    known = id_map.select("external_system", "external_id", F.col("entity_id").alias("mapped"), "is_active")
    judged = clean.join(known, ["external_system", "external_id"], "left").select(*clean.columns, "mapped", "is_active")
    none = F.lit(None)
    first = F.when(present("external_id").isNull(), "error_missing_external_id").when(F.col("is_active"), "updated").when(F.col("mapped").isNotNull(), "reactivated")
    judged = cut(judged.withColumn("load_action", first), "judged")
    fixed = judged.filter("load_action is not null").select(
        *clean.columns, "load_action", none.cast("string").alias("skip_reason"), F.when(F.col("load_action") != "error_missing_external_id", F.col("mapped")).alias("entity_id"), F.lit(False).alias("ambiguous")
    )
    base = core.agg(F.coalesce(F.max("person_id"), F.lit(0)).cast("long")).head()[0]
    waiting = judged.filter("load_action is null").select(*clean.columns)
    own = _keys(waiting, "clean_id")
    near = waiting.join(near_names(waiting, core, least_near), "name").select("clean_id", F.lit("name").alias("kind"), F.col("near").alias("value"), F.lit("fuzzy").alias("as_kind"))
    probes = cut(own.withColumn("as_kind", F.col("kind")).unionByName(near), "probes")
    keys_at, out_at = scratch_path(spark, "core_keys"), scratch_path(spark, "settled")
    _keys(core, "person_id").distinct().write.parquet(keys_at)
    read_keys = lambda: spark.read.schema("person_id long, kind string, value string").parquet(keys_at)
    done, folded = 0, False

    def write(settled: DataFrame) -> DataFrame:
        """Writes a round's rows and appends their keys; gives the rows still waiting."""
        nonlocal done
        settled.select(*fixed.columns).write.parquet(f"{out_at}/round={done}")
        rows = spark.read.schema(fixed.schema).parquet(f"{out_at}/round={done}")
        new = rows.filter("load_action = 'inserted'").withColumn("person_id", F.col("entity_id"))
        added = rows.filter("skip_reason = 'DUPLICATE_NAME' and mail is not null").select(F.col("entity_id").alias("person_id"), F.lit("mail").alias("kind"), F.col("mail").alias("value"))
        _keys(new, "person_id").unionByName(added).distinct().write.mode("append").parquet(keys_at)
        done += 1
        return cut(waiting.join(rows.select("clean_id"), "clean_id", "left_anti"), "waiting")

    while not waiting.isEmpty():
        free = _free(probes, waiting, read_keys())
        if done >= rounds and not folded:
            folded = True
            holders = free.groupBy("kind", "value").agg(F.min("clean_id").alias("a"))
            groups = components(free.join(holders, ["kind", "value"]).select("a", F.col("clean_id").alias("b")))
            groups = cut(groups.select(F.col("node").alias("clean_id"), F.col("component").alias("group")), "groups")
            sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= largest)
            groups = cut(groups.join(sizes.select("group"), "group", "left_semi"), "groups")
            waiting = write(waiting.join(_fold(waiting, groups, read_keys(), probes, base), "clean_id"))
            continue
        least = free.filter("as_kind <> 'fuzzy'").groupBy("kind", "value").agg(F.min("clean_id").alias("first_id"))
        held = free.join(least, ["kind", "value"]).filter("clean_id > first_id").select("clean_id").distinct()
        settled = _settle(waiting.join(held, "clean_id", "left_anti"), read_keys(), probes)
        waiting = write(settled.withColumn("entity_id", F.coalesce("entity_id", F.when(F.col("load_action") == "inserted", F.col("clean_id") + base))))
    if not done:
        return fixed
    out = spark.read.schema(fixed.schema).option("basePath", out_at).parquet(*[f"{out_at}/round={r}" for r in range(done)])
    return fixed.unionByName(out.select(*fixed.columns))


def apply_updates(loaded: DataFrame, core: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(loaded with no-change actions, core after, change log) of the rows that meet a person of the core.

    loaded: clean_id, entity_id, load_action, external_system, the fields and, if there are any, manual (a map of fields
    to values that a steward set). core: person_id, source, email_verified and the fields. Of each field the manual
    value wins, then a verified e-mail of the core, then the incoming value, then the core's own; blanks never clear
    anything. Several rows of one person are applied in the order of clean_id, each against what the ones before left.
    """
    hits = loaded.filter(F.col("load_action").isin("updated", "reactivated", "deterministic_update"))
    manual = (lambda f: F.try_element_at("manual", F.lit(f))) if "manual" in loaded.columns else (lambda f: F.lit(None).cast("string"))
    was = core.select(F.col("person_id").alias("entity_id"), F.struct("source", F.coalesce("email_verified", F.lit(False)).alias("email_verified"), *fields).alias("was"))
    rows = hits.join(was, "entity_id")
    before = Window.partitionBy("entity_id").orderBy("clean_id").rowsBetween(Window.unboundedPreceding, -1)
    state, rules = {}, {}
    for f in (*fields, "source"):
        incoming = F.col("external_system") if f == "source" else F.coalesce(present(manual(f)), F.when(F.col("was.email_verified") & F.col("was.email").isNotNull(), None).otherwise(present(f)) if f == "email" else present(f))
        rules[f] = incoming
        state[f] = F.coalesce(F.last(F.col(f"in_{f}"), True).over(before), F.col(f"was.{f}"))
    rows = rows.withColumns({f"in_{f}": c for f, c in rules.items()})
    rows = rows.withColumns({f"old_{f}": c for f, c in state.items()})
    changed = [
        F.when(F.col(f"in_{f}").isNotNull() & ~F.col(f"in_{f}").eqNullSafe(F.col(f"old_{f}")), F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f"in_{f}").alias("new_value"))) for f in rules
    ]
    rows = cut(rows.select("clean_id", "entity_id", *[f"in_{f}" for f in rules], F.array_compact(F.array(*changed)).alias("changes")), "applied")
    log = rows.select("clean_id", "entity_id", F.explode("changes").alias("c")).select("clean_id", "entity_id", "c.*")
    quiet = rows.filter(F.size("changes") == 0).select("clean_id", F.lit(True).alias("quiet"))
    same = F.create_map(*[F.lit(x) for kv in NO_CHANGE.items() for x in kv])
    judged = loaded.join(quiet, "clean_id", "left").withColumn("load_action", F.when(F.col("quiet"), F.coalesce(same[F.col("load_action")], F.col("load_action"))).otherwise(F.col("load_action"))).select(*loaded.columns)
    last = rows.groupBy(F.col("entity_id").alias("person_id")).agg(*[F.max_by(f"in_{f}", F.when(F.col(f"in_{f}").isNotNull(), F.col("clean_id"))).alias(f"in_{f}") for f in rules])
    after = core.join(last, "person_id", "left")
    reset = F.when(F.col("in_email").isNotNull() & ~F.col("in_email").eqNullSafe(F.col("email")), False).otherwise(F.col("email_verified"))
    new = {f: F.coalesce(f"in_{f}", f) for f in rules} | {"email_verified": reset}
    return judged, after.select(*[new[c].alias(c) if c in new else F.col(c) for c in core.columns]), log


def added_emails(loaded: DataFrame, emails: DataFrame) -> DataFrame:
    """(entity_id, email, is_primary): addresses that rows of a known name add to their person; primary only where there is none."""
    new = loaded.filter("skip_reason = 'DUPLICATE_NAME' and mail is not null").groupBy("entity_id", F.col("mail").alias("email")).agg(F.min("clean_id").alias("clean_id"))
    new = new.join(emails.select("entity_id", F.lower("email").alias("email")).distinct(), ["entity_id", "email"], "left_anti")
    has = emails.groupBy("entity_id").agg(F.bool_or("is_primary").alias("has"))
    firsts = new.groupBy("entity_id").agg(F.min_by("email", F.struct("clean_id", "email")).alias("first_email"))
    both = new.join(has, "entity_id", "left").join(firsts, "entity_id")
    return both.select("entity_id", "email", (~F.coalesce("has", F.lit(False)) & (F.col("email") == F.col("first_email"))).alias("is_primary"))


# The counters of a load and the actions that each one counts.
COUNTERS = {
    "rows_created": ("inserted",),
    "rows_updated": ("updated", "deterministic_update"),
    "rows_reactivated": ("reactivated",),
    "rows_skipped_no_change": ("skipped_no_change", "deterministic_no_change"),
    "rows_skipped_duplicates": ("skipped_duplicate", "skipped_duplicate_fuzzy"),
    "rows_deduped_auto": ("deterministic_update", "deterministic_no_change"),
    "rows_missing_external_id": ("error_missing_external_id",),
}


def summary(loaded: DataFrame) -> DataFrame:
    """Rows by action."""
    return loaded.groupBy("load_action").agg(F.count(F.lit(1)).alias("n"))


def load_summary(loaded: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: rows processed, each counter, and how many different addresses were duplicates.

    A dry run creates nothing: it counts what would be inserted as potential inserts.
    """
    of = {name: F.count_if(F.col("load_action").isin(*actions)) for name, actions in COUNTERS.items()}
    potential = of["rows_created"]
    if dry_run:
        of["rows_created"] = F.lit(0).cast("long")
    extra = F.count_distinct(F.when(F.col("skip_reason") == "DUPLICATE_EMAIL", F.col("mail"))).alias("duplicate_emails")
    return loaded.agg(F.count(F.lit(1)).alias("rows_processed"), *[c.alias(n) for n, c in of.items()], potential.alias("potential_inserts"), extra)


def duplicate_emails(loaded: DataFrame) -> DataFrame:
    """The addresses that made rows duplicates, and of how many rows."""
    return loaded.filter("skip_reason = 'DUPLICATE_EMAIL'").groupBy("mail").agg(F.count(F.lit(1)).alias("n"))


def new_id_map(loaded: DataFrame, id_map: DataFrame, seen_at: Column) -> DataFrame:
    """The id map after a run: seen entries are active again and stamped, inserted and name-linked rows get entries."""
    key = ["external_system", "external_id"]
    seen = loaded.filter(F.col("load_action").isin("updated", "reactivated")).select(*key, F.lit(True).alias("seen")).distinct()
    old = id_map.join(seen, key, "left")
    kept = old.select(*key, "entity_id", (F.col("is_active") | F.coalesce("seen", F.lit(False))).alias("is_active"), "first_seen_at", F.when(F.col("seen"), seen_at).otherwise(F.col("last_seen_at")).alias("last_seen_at"))
    added = loaded.filter((F.col("load_action") == "inserted") | (F.col("skip_reason") == "DUPLICATE_NAME"))
    return kept.unionByName(added.select(*key, "entity_id", F.lit(True).alias("is_active"), seen_at.alias("first_seen_at"), seen_at.alias("last_seen_at")))


# What a skip says of its row.
SKIP_TEXT = {"DUPLICATE_EMAIL": "Duplicate email address", "DUPLICATE_NAME": "Duplicate name", "DUPLICATE_FUZZY": "Similar name"}


def skips(loaded: DataFrame) -> DataFrame:
    """One row for each skipped one: type, a message with what it met, the key "name (mail)"."""
    text = F.create_map(*[F.lit(x) for kv in SKIP_TEXT.items() for x in kv])[F.col("skip_reason")]
    met = F.when(F.col("skip_reason") == "DUPLICATE_EMAIL", F.col("mail")).otherwise(F.concat(F.col("name"), F.lit(" (matched person "), F.col("entity_id").cast("string"), F.lit(")")))
    key = F.when((F.col("skip_reason") == "DUPLICATE_EMAIL") & F.col("mail").isNotNull(), F.concat(F.coalesce("name", F.lit("")), F.lit(" ("), F.col("mail"), F.lit(")"))).otherwise(F.col("name"))
    return loaded.filter("skip_reason is not null").select("clean_id", F.col("skip_reason").alias("skip_type"), F.concat(text, F.lit(": "), met).alias("skip_reason"), key.alias("record_key"), "entity_id")


def load_suggestions(loaded: DataFrame) -> DataFrame:
    """Automatic merges (score 1), similar names (score 0.95) and ambiguous rows for review (no primary, no score)."""
    row = lambda f, primary, score, kind, decision: f.select("clean_id", primary.cast("long").alias("primary_id"), F.lit(score).cast("double").alias("score"), F.lit(kind).alias("match_type"), F.lit(decision).alias("decision"))
    none, person = F.lit(None), F.col("entity_id")
    auto = row(loaded.filter(F.col("load_action").isin("deterministic_update", "deterministic_no_change")), person, 1.0, "deterministic", "auto_merged")
    near = row(loaded.filter("load_action = 'skipped_duplicate_fuzzy'"), person, NEAR_NAME, "fuzzy_name", "pending")
    return auto.unionByName(near).unionByName(row(loaded.filter("ambiguous"), none, None, "ambiguous", "pending"))


def created_tables(inserted: DataFrame) -> dict[str, DataFrame]:
    """contact, e-mail, phone and address rows of inserted people; addresses need street, city, state and postal code."""
    whole = F.lit(True)
    for c in ("street", "city", "state_code", "postal_code"):
        whole = whole & present(c).isNotNull()
    return {
        "contacts": inserted.select("entity_id", present("first_name").alias("first_name"), present("last_name").alias("last_name"), parse_birthdate("dob").alias("birthdate")),
        "emails": inserted.filter(present("email").isNotNull()).select("entity_id", F.lower(present("email")).alias("email"), F.lit(True).alias("is_primary")),
        "phones": inserted.filter(present("phone").isNotNull()).select("entity_id", present("phone").alias("phone"), F.lit(True).alias("is_primary")),
        "addresses": inserted.filter(whole).select("entity_id", "street", "city", "state_code", "postal_code", F.coalesce(present("country_code"), F.lit("US")).alias("country_code")),
    }


def upsert(base: DataFrame, incoming: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """One row per key of either side: action (created, updated, unchanged, deleted, kept) by payload hash.

    Both sides have the key and `hash`; incoming may have a flag that deletes. One full outer join on the key.
    """
    b = base.select(key, F.col("hash").alias("old_hash"))
    i = incoming.select(key, F.col("hash").alias("new_hash"), (F.col(deleted) if deleted else F.lit(False)).alias("gone"))
    both = b.join(i, key, "full_outer")
    action = (
        F.when(F.col("new_hash").isNull(), "kept")
        .when(F.col("gone"), "deleted")
        .when(F.col("old_hash").isNull(), "created")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("updated")
    )
    return both.withColumn("action", action)


def change_log(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old_value, new_value) of every field that differs between two snapshots of the same keys."""
    o = old.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("o"))
    n = new.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("n"))
    rows = [F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old_value"), F.col(f"n.{f}").alias("new_value"))) for f in fields]
    return o.join(n, key).select(key, F.explode(F.array_compact(F.array(*rows))).alias("c")).select(key, "c.*")


def payload_diff(before: str, after: str) -> Column:
    """Of two map columns the keys whose values differ, as key -> struct(before, after)."""
    both = F.map_zip_with(before, after, lambda k, b, a: F.struct(b.alias("before"), a.alias("after")))
    return F.map_filter(both, lambda k, v: ~v["before"].eqNullSafe(v["after"]))


def single_primary(rows: DataFrame, owner: str, *newest_first: Column) -> DataFrame:
    """rows with is_primary true for exactly one row of each owner."""
    return rows.withColumn("is_primary", F.row_number().over(Window.partitionBy(owner).orderBy(*newest_first)) == 1)


def pick_by_preference(rows: DataFrame, owner: str, kind: str, preferred: Column, order: str, value: str) -> DataFrame:
    """The different values of each owner with is_primary: of the preferred kind if there is one, else the first by order.

    Of repeated values the first by order stays. Two aggregates; no owner's rows are gathered.
    """
    own = [owner, value]
    others = [c for c in rows.columns if c not in own]
    firsts = rows.groupBy(*own).agg(F.min_by(F.struct(*others), order).alias("r")).select(*own, *[F.col(f"r.{c}").alias(c) for c in others])
    best = firsts.groupBy(owner).agg(F.min_by(F.struct(value), F.struct((~F.coalesce(F.lower(kind) == F.lower(preferred), F.lit(False))).alias("other"), F.col(order))).alias("best"))
    return firsts.join(best, owner).withColumn("is_primary", F.col(value) == F.col(f"best.{value}")).drop("best")


def unique_slugs(rows: DataFrame, base: str, ident: str, taken: DataFrame | None = None) -> DataFrame:
    """rows with slug: the base, or the first of base-1, base-2, ... that neither `taken` (column slug) nor an earlier row has.

    Rows of a base number its free suffixes in the order of ident. Slugs of different bases can meet (fair-1 is a base
    as well as the second fair): the earliest row has it, and the others of its base from there on try again, as long as
    there are any.
    """
    spark = rows.sparkSession
    columns = rows.columns
    used = cut((taken.select("slug") if taken is not None else rows.select(F.col(base).alias("slug")).limit(0)).filter("slug is not null").distinct(), "slugs")
    todo, out = cut(rows, "unslugged"), None
    while not todo.isEmpty():
        # Used numbers by base; a run of them from k on passes all free numbers from one place on.
        number = F.regexp_extract("slug", r"-([1-9][0-9]*)$", 1).try_cast("long")
        held = used.select(F.col("slug").alias(base), F.lit(0).cast("long").alias("k")).unionByName(used.filter(number > 0).select(F.regexp_replace("slug", r"-[0-9]+$", "").alias(base), number.alias("k")))
        held = number_within(held.join(todo.select(base).distinct(), base, "left_semi").distinct(), [base], ["k"], "below")
        gaps = held.groupBy(base, (F.col("k") - F.col("below")).alias("free")).agg((F.max("below") + 1).alias("passed"))
        gaps = gaps.groupBy(base).agg(F.collect_list(F.struct("free", "passed")).alias("gaps"))  # one entry a gap
        placed = number_within(todo, [base], [ident]).join(gaps, base, "left")
        passed = F.aggregate(F.coalesce("gaps", F.array().cast("array<struct<free:bigint,passed:bigint>>")), F.lit(0).cast("long"), lambda m, g: F.when(g["free"] <= F.col("n"), F.greatest(m, g["passed"])).otherwise(m))
        tried = placed.withColumn("k", F.col("n") + passed)
        tried = cut(tried.select(*columns, "n", F.when(F.col("k") == 0, F.col(base)).otherwise(F.concat_ws("-", base, F.col("k").cast("string"))).alias("slug")), "slugged")
        lost = tried.join(tried.groupBy("slug").agg(F.min(ident).alias("_first")), "slug").filter(F.col(ident) > F.col("_first"))
        until = lost.groupBy(base).agg(F.min("n").alias("_until"))
        judged = tried.join(until, base, "left").withColumn("_won", F.col("n") < F.coalesce("_until", F.lit((1 << 62))))
        won = cut(judged.filter("_won").select(*columns, "slug"), "won")
        out = won if out is None else out.unionByName(won)
        used = cut(used.unionByName(won.select("slug")), "slugs")
        todo = cut(judged.filter("not _won").select(*columns), "unslugged")
    return out if out is not None else spark.createDataFrame([], rows.withColumn("slug", F.lit("")).schema)
