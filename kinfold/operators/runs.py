"""Runs, their violations, skips and suggestions: filters, pages with totals, roll-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import filter_date, present
from kinfold.operators.reports import sorted_page

# Sizes of pages, the counters of a run by stage, and the latest runs of a report.
RUN_PAGE, VIOLATION_PAGE = 100, 200
RUN_COUNTERS = {
    "staging": ("rows_staged",),
    "dq": ("rows_validated", "rows_quarantined"),
    "core": ("rows_created", "rows_updated", "rows_reactivated", "rows_skipped_duplicates", "rows_skipped_no_change", "rows_deduped_auto", "rows_missing_external_id", "rows_soft_deleted"),
}
LATEST_RUNS = 5


@dataclass(frozen=True)
class Filters:
    """A request's filters: empty values take all. Values outside an allowed list are errors."""

    status: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    dry_run: bool | None = None
    since: str | None = None
    until: str | None = None
    search: str | None = None
    page: int = 1
    size: int = 25

    def checked(self, statuses: tuple[str, ...], most: int = RUN_PAGE) -> Filters:
        unknown = [s for s in self.status if s not in statuses]
        if unknown:
            raise ValueError(f"unknown status: {unknown}")
        return Filters(self.status, self.source, self.dry_run, self.since, self.until, self.search, max(1, self.page), max(1, min(most, self.size)))


def one_of(column: str, values: tuple) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def between(column: str, since: str | None, until: str | None) -> Column:
    """From a bound to another; a date as the upper bound means its last moment."""
    ok = F.lit(True)
    if since:
        ok = ok & (F.col(column) >= filter_date(F.lit(since)))
    if until:
        ok = ok & (F.col(column) <= filter_date(F.lit(until), True))
    return ok


def contains(term: str | None, *columns: str) -> Column:
    """Whether a column contains the term in any case; wildcards of the term are plain characters."""
    if not term:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(term.lower()), F.lit(False))
    return hit


def filter_runs(runs: DataFrame, f: Filters) -> DataFrame:
    """Runs by status, source, dry run, start and text; a number also finds the run with that id."""
    found = contains(f.search, "source", "adapter", "notes")
    if f.search and f.search.strip().isdigit():
        found = found | (F.col("run_id") == int(f.search))
    dry = F.lit(True) if f.dry_run is None else F.coalesce(F.col("dry_run"), F.lit(False)) == f.dry_run
    return runs.filter(one_of("status", f.status) & one_of("source", f.source) & dry & between("started_at", f.since, f.until) & found)


def filter_violations(violations: DataFrame, f: Filters, rules: tuple[str, ...] = (), severities: tuple[str, ...] = (), run_ids: tuple[int, ...] = ()) -> DataFrame:
    return violations.filter(
        one_of("status", f.status) & one_of("rule_code", rules) & one_of("severity", severities) & one_of("run_id", run_ids) & between("created_at", f.since, f.until) & contains(f.search, "message", "record_key", "rule_code")
    )


def filter_skips(skips: DataFrame, search: str | None, types: tuple[str, ...] = ()) -> DataFrame:
    return skips.filter(one_of("skip_type", types) & contains(search, "record_key"))


def stage_rows(rows: DataFrame, run_id: int, status: str) -> DataFrame:
    """The rows of a run in a state, in their order."""
    return rows.filter((F.col("run_id") == run_id) & (F.col("status") == status)).orderBy("sequence_number")


def page_with_total(rows: DataFrame, sort: str, allowed: dict[str, str], ident: str, page: int, size: int, most: int = RUN_PAGE) -> DataFrame:
    """A page of rows, each with the total and the number of pages; a page past the end is empty."""
    size = max(1, min(most, size))
    total = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return sorted_page(rows, sort, allowed, ident, page, size, most).join(F.broadcast(total))  # one row


def duration_seconds(runs: DataFrame, now: Column) -> Column:
    return (F.unix_micros(F.coalesce(F.col("finished_at").cast("timestamp"), now)) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6


def can_retry(params: str, files: list[str]) -> Column:
    """A run can start anew if it kept its file and the file is among those that are there."""
    path = F.get_json_object(params, "$.file_path")
    kept = F.coalesce(F.get_json_object(params, "$.keep_file") == "true", F.lit(False))
    return F.coalesce(kept & present(path).isNotNull() & path.isin(*files), F.lit(False)) if files else F.lit(False)


def run_summaries(runs: DataFrame, suggestions: DataFrame, now: Column, files: list[str]) -> DataFrame:
    """One row for each run: counters out of its JSON (missing: 0), duration, suggestions by decision, whether it can be retried."""
    counters = [F.coalesce(F.get_json_object("counts_json", f"$.{stage}.volunteers.{name}").try_cast("long"), F.lit(0)).alias(name) for stage, names in RUN_COUNTERS.items() for name in names]
    changed = F.coalesce(F.get_json_object("counts_json", "$.core.volunteers.rows_changed").try_cast("long"), F.get_json_object("counts_json", "$.core.volunteers.rows_updated").try_cast("long"), F.lit(0)).alias("rows_changed")
    made = suggestions.groupBy("run_id").agg(F.count_if(F.col("decision") == "auto_merged").alias("rows_dedupe_auto"), F.count_if(F.col("decision") == "pending").alias("rows_dedupe_manual_review"))
    facts = runs.select("run_id", "source", "status", "dry_run", duration_seconds(runs, now).alias("duration_seconds"), *counters, changed, can_retry("ingest_params", files).alias("can_retry"))
    return facts.join(made, "run_id", "left").fillna(0, ["rows_dedupe_auto", "rows_dedupe_manual_review"])


def decisions_by_run(suggestions: DataFrame) -> DataFrame:
    """Suggestions of each run by decision."""
    return suggestions.groupBy("run_id", "decision").agg(F.count(F.lit(1)).alias("n"))


def clean_rows_of_latest(runs: DataFrame, clean: DataFrame, latest: int = LATEST_RUNS) -> DataFrame:
    """How many clean rows each of the latest runs has, the newest first."""
    last = runs.select("run_id", "started_at").orderBy(F.desc("run_id")).limit(latest)
    counted = clean.join(F.broadcast(last.select("run_id")), "run_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("clean_rows"))
    return last.join(counted, "run_id", "left").fillna(0, ["clean_rows"])


def latest_run(runs: DataFrame, source: str) -> DataFrame:
    """The run of a source with the largest id."""
    return runs.filter(F.col("source") == source).orderBy(F.desc("run_id")).limit(1)


def touched_maps(id_map: DataFrame, run_id: int, started: Column) -> DataFrame:
    """Entries that a run touched by its id, and those seen since it began; each once, by its id first."""
    by_run = F.col("run_id").eqNullSafe(F.lit(run_id))
    return id_map.filter(by_run | (F.col("last_seen_at") >= started)).withColumn("found_by", F.when(by_run, "run").otherwise("seen"))


def with_review_names(suggestions: DataFrame, contacts: DataFrame, merge_log: DataFrame) -> DataFrame:
    """Review rows with both people's names and, for automatic merges, the log entry that names the suggestion in its JSON."""
    name = lambda side: contacts.select(F.col("person_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    logs = merge_log.select(F.get_json_object("undo_payload", "$.suggestion_id").try_cast("long").alias("suggestion_id"), "merge_id").filter("suggestion_id is not null")
    logs = logs.groupBy("suggestion_id").agg(F.max("merge_id").alias("merge_id"))
    both = suggestions.join(name("primary"), "primary_id", "left").join(name("candidate"), "candidate_id", "left").join(logs, "suggestion_id", "left")
    return both.withColumn("merge_id", F.when(F.col("decision") == "auto_merged", F.col("merge_id")))


def population_overview(stats: DataFrame) -> DataFrame:
    """Mapped and unmapped fields of an import and the mean population rate of the mapped ones."""
    mapped = F.col("target").isNotNull()
    return stats.agg(F.count_if(mapped).alias("mapped_fields"), F.count_if(~mapped).alias("unmapped_fields"), F.round(F.coalesce(F.avg(F.when(mapped, F.col("population_rate"))), F.lit(0.0)), 3).alias("average_population"))


def target_contributors(stats: DataFrame, total: Column) -> DataFrame:
    """Of each target the source fields that feed it, their values in sum, and how complete that makes it (1 at most)."""
    filled = F.sum("mapped")
    return stats.filter("target is not null").groupBy("target").agg(F.array_sort(F.collect_set("field")).alias("contributors"), filled.alias("filled"), F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(filled * 1.0, F.max(total)), F.lit(0.0))), 4).alias("completeness_rate"))


def source_count_check(loaded: DataFrame, source_counts: DataFrame) -> DataFrame:
    """Rows of each object here against what the source says it has."""
    here = loaded.groupBy("object_name").agg(F.count(F.lit(1)).alias("loaded"))
    both = source_counts.select("object_name", "expected").join(here, "object_name", "full_outer").fillna(0, ["expected", "loaded"])
    return both.withColumns({"missing": F.col("expected") - F.col("loaded"), "matches": F.col("expected") == F.col("loaded")})
