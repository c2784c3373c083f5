"""Review queue, merges and their undo: every step gives new snapshots of the tables it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.scalar import present
from kinfold.operators.materialize import cut
from kinfold.operators.survivorship import DEFAULT, Profile, decide

AUTO_BATCH = 50
# Decisions that each step may start from.
REJECT_FROM, DEFER_FROM = ("pending", "deferred"), ("pending",)


def review_queue(suggestions: DataFrame) -> DataFrame:
    return suggestions.filter("decision = 'pending' and primary_id is not null").orderBy(F.desc_nulls_last("score"), "suggestion_id")


def queue_stats(suggestions: DataFrame) -> DataFrame:
    open_ = (F.col("decision") == "pending") & F.col("primary_id").isNotNull()
    return suggestions.agg(
        F.count_if(open_ & (F.col("match_type") == "high")).alias("pending_high"),
        F.count_if(open_ & (F.col("match_type") == "review")).alias("pending_review"),
        F.count_if(open_).alias("pending_total"),
        F.count_if(F.col("decision") == "auto_merged").alias("auto_merged"),
    )


def aging(created: Column, as_of: Column) -> Column:
    """Buckets of a day each, half open, by the microsecond."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    age, day = micros(as_of) - micros(created), 24 * 3600 * 1_000_000
    return F.when(age < day, "under_24h").when(age < 2 * day, "24h_to_48h").otherwise("over_48h")


def run_aging(suggestions: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """One row: pending suggestions with a primary, by the age of the run that made them; those of unknown runs don't count.

    Runs without a date are of no age. Suggestions are counted by run before they meet the runs.
    """
    waiting = suggestions.filter((F.col("decision") == "pending") & F.col("primary_id").isNotNull()).groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    aged = waiting.join(runs.select("run_id", aging(F.col("created_at"), as_of).alias("_age"), "created_at"), "run_id").filter("created_at is not null")
    return aged.agg(*[F.coalesce(F.sum(F.when(F.col("_age") == b, F.col("_n"))), F.lit(0)).cast("long").alias(b) for b in ("under_24h", "24h_to_48h", "over_48h")])


def change_decision(suggestions: DataFrame, ids: DataFrame, to: str, start_from: tuple[str, ...], note: Column | None = None) -> DataFrame:
    """suggestions with the decision of the given ids changed where their state allows it."""
    marked = suggestions.join(ids.select("suggestion_id", F.lit(True).alias("_hit")).distinct(), "suggestion_id", "left")
    hit = F.col("_hit") & F.col("decision").isin(*start_from)
    return marked.withColumn("decision", F.when(hit, F.lit(to)).otherwise(F.col("decision"))).drop("_hit")


def reject(suggestions: DataFrame, ids: DataFrame) -> DataFrame:
    return change_decision(suggestions, ids, "rejected", REJECT_FROM)


def defer(suggestions: DataFrame, ids: DataFrame) -> DataFrame:
    return change_decision(suggestions, ids, "deferred", DEFER_FROM)


def auto_merge_batch(suggestions: DataFrame, limit: int = AUTO_BATCH) -> DataFrame:
    """The next high-band suggestions to merge, the surest first; a bounded batch by design."""
    return review_queue(suggestions.filter("match_type = 'high'")).limit(limit)


def merge_people(people: DataFrame, pairs: DataFrame, profile: Profile = DEFAULT, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(people after, merge log) of merging each candidate into its primary.

    people: person_id and the profile's fields; pairs: suggestion_id, primary_id, candidate_id, each candidate in one
    pair and no primary a candidate (resolved_pairs makes them so). Of several candidates of one primary the first by
    suggestion gives each missing value. The candidate's values count as incoming; overrides (suggestion_id, field -> value map) as manual. The
    log has both sides before and the survivor after, which is all that undo needs.
    """
    fields = [f for g in profile.groups.values() for f in g if f in people.columns]
    side = lambda name: people.select(F.col("person_id").alias(f"{name}_id"), F.struct(*fields).alias(name))
    both = pairs.select("suggestion_id", "primary_id", "candidate_id").join(side("primary"), "primary_id").join(side("candidate"), "candidate_id")
    if overrides is not None:
        both = both.join(overrides.select("suggestion_id", "overrides"), "suggestion_id", "left")
    by_primary = both.groupBy("primary_id").agg(
        *[F.min_by(F.col(f"candidate.{f}"), F.when(present(F.col(f"candidate.{f}").cast("string")).isNotNull(), F.col("suggestion_id"))).alias(f"in_{f}") for f in fields],
        *([F.min_by(F.try_element_at("overrides", F.lit(f)), F.when(F.try_element_at("overrides", F.lit(f)).isNotNull(), F.col("suggestion_id"))).alias(f"by_{f}") for f in fields] if overrides is not None else []),
    )
    both = both.join(by_primary, "primary_id")
    values = []
    for f in fields:
        tiers = {"existing_core": F.col(f"primary.{f}"), "incoming": F.col(f"in_{f}")}
        if overrides is not None:
            tiers["manual"] = F.col(f"by_{f}")
        order = ("manual", "existing_core", "incoming")  # the survivor's own values win over those merged into it
        values.append(decide(tiers, order)["value"].alias(f))
    log = both.select("suggestion_id", "primary_id", "candidate_id", F.col("primary").alias("primary_before"), F.col("candidate").alias("candidate_before"), F.struct(*values).alias("primary_after"))
    kept = log.groupBy(F.col("primary_id").alias("person_id")).agg(F.min_by("primary_after", "suggestion_id").alias("primary_after"))
    after = people.join(kept, "person_id", "left").join(log.select(F.col("candidate_id").alias("person_id")), "person_id", "left_anti")
    rest = [F.when(F.col("primary_after").isNotNull(), F.col(f"primary_after.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in people.columns]
    return after.select(*rest), log


def repoint(id_map: DataFrame, log: DataFrame) -> DataFrame:
    """The id map with entries of merged candidates on their primaries; came_from keeps the way back."""
    moved = log.select(F.col("candidate_id").alias("entity_id"), "primary_id")
    both = id_map.join(moved, "entity_id", "left")
    return both.select(*[c for c in id_map.columns if c not in ("entity_id", "came_from")], F.coalesce("primary_id", "entity_id").alias("entity_id"), F.when(F.col("primary_id").isNotNull(), F.col("entity_id")).alias("came_from"))


def undo_merge(people: DataFrame, log: DataFrame) -> DataFrame:
    """people with both sides of logged merges as they were; entries whose candidate is back already change nothing."""
    there = people.select(F.col("person_id").alias("candidate_id"))
    due = log.join(there, "candidate_id", "left_anti")
    fields = log.schema["primary_before"].dataType.names
    restored = due.groupBy(F.col("primary_id").alias("person_id")).agg(F.min_by("primary_before", "suggestion_id").alias("s"))
    kept = people.join(restored, "person_id", "left")
    kept = kept.select(*[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in people.columns])
    back = due.select(F.col("candidate_id").alias("person_id"), "candidate_before.*")
    return kept.unionByName(back, allowMissingColumns=True)


def candidate_details(suggestions: DataFrame, people: DataFrame, profile: Profile = DEFAULT) -> DataFrame:
    """Suggestions with both sides and, of each field, the value that a merge would keep and the side it comes from."""
    fields = [f for g in profile.groups.values() for f in g if f in people.columns]
    side = lambda name: people.select(F.col("person_id").alias(f"{name}_id"), F.struct(*fields).alias(name))
    both = suggestions.join(side("primary"), "primary_id").join(side("candidate"), "candidate_id")
    kept = []
    for f in fields:
        d = decide({"existing_core": F.col(f"primary.{f}"), "incoming": F.col(f"candidate.{f}")}, ("existing_core", "incoming"))
        kept.append(F.struct(F.lit(f).alias("field"), d["value"].alias("value"), F.when(d["value"].isNull(), None).when(d["tier"] == "incoming", "candidate").otherwise("primary").alias("side")))
    return both.select("suggestion_id", "primary_id", "candidate_id", "primary", "candidate", F.array(*kept).alias("preview"))


def final_persons(links: DataFrame) -> DataFrame:
    """(person_id, final_id) for links (person_id, into_id; one for each person): where the links end.

    A ring ends at its least person. Links are followed by doubling: each round a person points twice as far and knows
    the least person on the way, until all that are pointed at lie on rings (a person without a link is a ring of its
    own) and know the least of theirs; so a chain costs its logarithm in rounds.
    """
    ends = links.select(F.col("into_id").alias("person_id")).distinct().join(links, "person_id", "left_anti").select("person_id", F.col("person_id").alias("into_id"))
    step = cut(links.select("person_id", "into_id").unionByName(ends), "step")
    now = step.select("person_id", F.col("into_id").alias("to"), "person_id").toDF("person_id", "to", "low")
    while True:
        reached = now.select(F.col("to").alias("person_id")).distinct()
        here = reached.join(step, "person_id").join(now.select("person_id", F.col("low").alias("low")), "person_id")
        beyond = now.select(F.col("person_id").alias("into_id"), F.col("low").alias("next_low"))
        state = here.join(beyond, "into_id").agg(F.count(F.lit(1)), F.count_distinct("into_id"), F.count_if(F.col("low") != F.col("next_low"))).head()
        low_of = now.select(F.col("person_id").alias("to"), F.col("to").alias("far"), F.col("low").alias("far_low"))
        if state[0] == state[1] and not state[2]:
            return now.join(low_of, "to").select("person_id", F.col("far_low").alias("final_id"))
        now = cut(now.join(low_of, "to").select("person_id", F.col("far").alias("to"), F.least("low", "far_low").alias("low")), "step")


def resolved_pairs(pairs: DataFrame) -> DataFrame:
    """pairs with each primary replaced by the person it is merged into itself, down to the one that stays.

    A candidate of several pairs goes with the first by suggestion. Of persons that are merged in a ring, of whatever
    length, the least stays and all others go into it. Nulls and pairs of a person with itself are no merges.
    """
    real = pairs.filter("primary_id is not null and candidate_id is not null and primary_id <> candidate_id")
    first = real.groupBy("candidate_id").agg(F.min_by(F.struct("suggestion_id", "primary_id"), "suggestion_id").alias("p"))
    links = cut(first.select(F.col("candidate_id").alias("person_id"), F.col("p.primary_id").alias("into_id"), F.col("p.suggestion_id").alias("suggestion_id")), "links")
    ended = links.join(final_persons(links), "person_id").filter("person_id <> final_id")
    return ended.select("suggestion_id", F.col("final_id").alias("primary_id"), F.col("person_id").alias("candidate_id"))


def replay(own: DataFrame, merges: DataFrame, fields: list[str]) -> DataFrame:
    """own (person_id, fields) after merges (suggestion_id, primary_id, candidate_id; one for each candidate), as if done one by one.

    A merge gives a survivor the values that it lacks, and what the candidate has got from earlier merges comes with it.
    So a field has the first value that is there among the survivor, then its candidates in the order of their merges,
    each followed by its own candidates: the order of the merges on the way up. That way is found by doubling too.
    """
    up = cut(merges.select(F.col("candidate_id").alias("person_id"), F.col("primary_id").alias("to"), F.array("suggestion_id").alias("way")), "merges")
    while True:
        above = up.select(F.col("person_id").alias("to"), F.col("to").alias("far"), F.col("way").alias("far_way"))
        if up.join(above.select("to"), "to", "left_semi").isEmpty():
            break
        up = cut(up.join(above, "to", "left").select("person_id", F.coalesce("far", "to").alias("to"), F.concat(F.coalesce("far_way", F.array().cast(up.schema["way"].dataType)), "way").alias("way")), "merges")
    placed = own.join(up, "person_id", "left").select(F.coalesce("to", "person_id").alias("root"), F.coalesce("way", F.array().cast(up.schema["way"].dataType)).alias("way"), *fields)
    first = lambda f: F.coalesce(F.min_by(F.col(f), F.when(present(F.col(f).cast("string")).isNotNull(), F.col("way"))), F.min_by(F.col(f), F.when(F.size("way") == 0, F.col("way"))))
    return placed.groupBy(F.col("root").alias("person_id")).agg(*[first(f).alias(f) for f in fields])


def undo_by_replay(people: DataFrame, log: DataFrame, undone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, log) after undoing merges (suggestion_id), as if they had never been; other merges stay, in any order.

    log: all merges so far, as merge_people writes them, in the order of suggestion_id, and a flag `undone` once some
    are; the log that comes back has it and is the one to go on with. A person's own values are those before its first
    merge. The merges that are not undone are replayed over them; what was changed by hand since (a value that the merges
    don't give) is kept. Persons that no merge touched, and undone ids that the log lacks, change nothing.
    """
    fields = log.schema["primary_before"].dataType.names
    sides = log.select("suggestion_id", F.explode(F.array(F.struct(F.col("primary_id").alias("person_id"), F.col("primary_before").alias("v")), F.struct(F.col("candidate_id").alias("person_id"), F.col("candidate_before").alias("v")))).alias("s"))
    own = cut(sides.groupBy("s.person_id").agg(F.min_by("s.v", "suggestion_id").alias("v")).select("person_id", "v.*"), "own")
    log = log if "undone" in log.columns else log.withColumn("undone", F.lit(False))
    marked = log.join(undone.select("suggestion_id", F.lit(True).alias("_now")).distinct(), "suggestion_id", "left")
    rest = marked.withColumn("undone", F.col("undone") | F.coalesce("_now", F.lit(False))).select(*log.columns)
    was = replay(own, log.filter("not undone"), fields).select("person_id", F.struct(*fields).alias("was"))
    now = replay(own, rest.filter("not undone"), fields).select("person_id", F.struct(*fields).alias("now"))
    new = now.join(was, "person_id", "left").join(people, "person_id", "left")
    by_hand = lambda f: F.col("was").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"was.{f}"))
    new = new.select(*[F.when(by_hand(c), F.col(c)).otherwise(F.col(f"now.{c}")).alias(c) if c in fields else F.col(c) for c in people.columns])
    return people.join(own.select("person_id"), "person_id", "left_anti").select(*people.columns).unionByName(new), rest


def repointed_rows(id_map: DataFrame, log: DataFrame) -> DataFrame:
    """(entity_type, external_id, from_id, to_id) of every map entry that a merge moves, for the merge's log."""
    moved = log.select(F.col("candidate_id").alias("entity_id"), "primary_id")
    return id_map.join(moved, "entity_id").select("entity_type", "external_id", F.col("entity_id").alias("from_id"), F.col("primary_id").alias("to_id"))


def undo_repoint(id_map: DataFrame, log: DataFrame) -> DataFrame:
    """The id map with the entries that a merge moved back on their candidates."""
    back = log.select(F.col("candidate_id").alias("came_from"), F.lit(True).alias("_back")).distinct()
    both = id_map.join(back, "came_from", "left")
    out = [F.when(F.col("_back"), F.col("came_from")).otherwise(F.col("entity_id")).alias("entity_id") if c == "entity_id" else F.when(~F.coalesce("_back", F.lit(False)), F.col("came_from")).alias(c) if c == "came_from" else F.col(c) for c in id_map.columns]
    return both.select(*out)


def sweep(people: DataFrame, suggestions: DataFrame, id_map: DataFrame, limit: int = AUTO_BATCH, profile: Profile = DEFAULT) -> dict[str, DataFrame]:
    """One automatic batch: the surest high-band suggestions merged, the id map repointed, their decisions set."""
    batch = cut(resolved_pairs(auto_merge_batch(suggestions, limit)), "batch")
    after, log = merge_people(people, batch, profile)
    log = cut(log, "merge_log")
    done = change_decision(suggestions, log.select("suggestion_id"), "auto_merged", ("pending",))
    return {"people": after, "log": log, "id_map": repoint(id_map, log), "suggestions": done}
