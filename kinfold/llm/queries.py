"""The queries of the corpus operators: each applies one operator to its whole table, with its production parameters.

Null texts count as empty, rows that repeat an id are taken each by itself as their operator says, ties are settled by
the least id, an empty table gives no rows, and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import bpe_codec, exact_dedup, language_id, merkle, near_dedup, packing, prefix_trie, quality_rules, secret_scan, simhash, suffix_dedup, token_rollup, toxicity
from kinfold.llm.common import cut, remainder, scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for its text; null and empty texts are one group."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its bytes without strings that start earlier; nothing of empty ones."""
    done = suffix_dedup.strip_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict; empty ones fail the base rule."""
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, learned from the labels that are not held out; empty ones have the score of no evidence."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least one that links reach; empty ones are linked with nothing."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places; empty ones are the end id alone."""
    return packing.pack(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, learned from those that are not held out; `und` without a letter."""
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(remainder("doc_id", 3) != 1), "doc_id", "text", "lang")
    judged = language_id.predict(docs, model)
    return judged.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of its ids and of what they decode to; empty ones have none and decode to nothing."""
    done = bpe_codec.encode_decode(documents(spark, sf_dir))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def joined_spans(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base spans' counts and digest and all spans; empty ones have none."""
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after a history of whole-table batches, which must equal a plain recount.

    All documents are inserted with estimated counts (a token for four bytes), revised to their real counts, deleted
    and inserted again; the revisions, sent a second time at the end, change nothing.
    """
    docs = documents(spark, sf_dir)
    version = F.lit("byte_bpe_50k/1").alias("tokenizer")
    guess = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).alias("n_tokens")
    guessed = docs.select(F.lit(0).alias("seq"), "doc_id", version, "source", "lang", guess)
    counted = cut(token_rollup.count_tokens(docs).select(F.lit(0).alias("seq"), "doc_id", version, "source", "lang", "n_tokens"), "counted")
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    for batch, op, rows in (("import", "insert", guessed), ("recount", "revise", counted), ("withdrawal", "delete", counted), ("return", "insert", counted), ("recount", "revise", counted)):
        rollup.commit(batch, rows.withColumn("op", F.lit(op)))
    return rollup.totals()


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, roots and proof, and what its text without line ends (for every other one) folds to."""
    docs = documents(spark, sf_dir)
    tampered = F.when(remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = merkle.leaf_hash(*[tampered if c == "text" else F.col(c) for c in merkle.FIELDS])
    found = merkle.manifest(docs, carry={"claimed": claimed})
    folded = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), merkle.fold(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the least document that links reach; empty ones have fingerprint zero."""
    found = simhash.simhash_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, each rebuilt with the first turns of the first of its hundred."""
    own = prefix_trie.sequences_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    head = remainder("id", 6).cast("int")
    mixed = prefix_trie.rebuilt(cut(own, "conversations"), F.col("id") - F.col("id") % 100, head, 5)
    return prefix_trie.prefix_trie(mixed).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


#: Of the queries that SQL can express.
OP1_SQL = r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, cast(count(*) over (partition by t) as bigint) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL}
