"""Queries that run the operators over the test tables, and SQL that gives the same rows.

The tables hold no people, so small view adapters give columns the meaning that an operator needs; each adapter is
written once as columns and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import picklists, scalar, similarity
from kinfold.operators import alike, completeness, dq, load, mapping, match, merge, reports, sampling, search, survivorship
from kinfold.operators.materialize import cut
from kinfold.registry import oracle_sql, queries, query, sql_of, table  # noqa: F401
from kinfold.sources.sinks import guarded
from kinfold.streaming.incremental import after_mark

# --- people from parts: the name is "first last", the key the id -------------------------------------------------

PEOPLE_SQL = """
people as (select p_partkey as id, split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as last, p_brand, p_type, p_size, p_retailprice from part)
"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), words[0].alias("first"), words[1].alias("last"), "p_brand", "p_type", "p_size", "p_retailprice")


SCAN_SQL = f"""
with {PEOPLE_SQL}, names as (select distinct lower(first) f, lower(last) l from people),
sims as (select a.f fa, b.f fb, a.l, case when a.f = b.f then 1.0 else jaro_winkler_similarity(a.f || ' ' || a.l, b.f || ' ' || b.l) end as sim
  from names a join names b on a.l = b.l),
pairs as (select a.id as primary_id, b.id as candidate_id, s.sim as name_sim, a.first = b.first as same,
    greatest(0.0, 1 - abs(a.p_size - b.p_size) * 73 / 730.0) as dob, case when a.p_type = b.p_type then 1.0 else 0.0 end as addr,
    case when a.p_retailprice = b.p_retailprice then 1.0 else 0.0 end as alt
  from people a join people b on lower(a.last) = lower(b.last) and a.p_brand = b.p_brand and a.id < b.id
  join sims s on s.fa = lower(a.first) and s.fb = lower(b.first) and s.l = lower(a.last) where s.sim >= 0.80),
scored as (select primary_id, candidate_id, name_sim, case when same then least(1.0, 0.90 + dob * 0.05 + addr * 0.03 + alt * 0.02)
    else name_sim * 0.25 + dob * 0.20 + addr * 0.15 + alt * 0.20 end as score from pairs)
"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs: similarity once for each pair of distinct names in a block, then joined to the rows."""
    rows = people(spark, sf_dir).withColumns({"f": F.lower("first"), "l": F.lower("last")})
    names = rows.select("f", "l").distinct()
    both = names.alias("a").join(names.alias("b"), F.col("a.l") == F.col("b.l")).select(F.col("a.f").alias("f"), F.col("b.f").alias("g"), F.col("a.l").alias("l"))
    sims = both.withColumn("name_sim", similarity.name_similarity(F.col("f"), F.col("l"), F.col("g"), F.col("l"))).filter(F.col("name_sim") >= match.SCAN_LEAST_NAME)
    a = rows.select(F.col("id").alias("primary_id"), "f", "l", "p_brand", F.struct("first", "p_type", "p_size", "p_retailprice").alias("x"))
    b = rows.select(F.col("id").alias("candidate_id"), F.col("f").alias("g"), "l", "p_brand", F.struct("first", "p_type", "p_size", "p_retailprice").alias("y"))
    pairs = a.join(sims, ["f", "l"]).join(b, ["g", "l", "p_brand"]).filter("primary_id < candidate_id")
    dob = F.greatest(F.lit(0.0), 1 - F.abs(F.col("x.p_size") - F.col("y.p_size")) * 73 / F.lit(730.0))
    address = (F.col("x.p_type") == F.col("y.p_type")).cast("double")
    other = (F.col("x.p_retailprice") == F.col("y.p_retailprice")).cast("double")
    score = F.when(F.col("x.first") == F.col("y.first"), scalar.exact_name_score(dob, address, other)).otherwise(
        scalar.weighted_score({"name": F.col("name_sim"), "dob": dob, "address": address, "alternate_contact": other})
    )
    return pairs.select("primary_id", "candidate_id", "name_sim", score.alias("score"))


BAND_SQL = "case when round(score, 9) >= 0.95 then 'high' when round(score, 9) >= 0.60 then 'review' else 'low' end"


# Of all brands: what SCAN_SQL without the brand gives.
ALL_BRANDS_SQL = SCAN_SQL.replace(" and a.p_brand = b.p_brand", "")


def scan_all_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs of all brands, without those that can't reach the review band.

    Names that differ add too little for pairs without the same price, unless they are nearly equal; so most of them meet
    by their price too. Similarities are taken from the smaller id's name to the other's.
    """
    rows = people(spark, sf_dir).withColumns({"f": F.lower("first"), "l": F.lower("last")}).filter("f is not null and l is not null")
    fields = ["first", "p_type", "p_size", "p_retailprice"]
    names = rows.select("f", "l").distinct()
    whole = lambda c: F.concat(c, F.lit(" "), F.col("l"))
    both = names.join(names.withColumnRenamed("f", "g"), "l").filter("f < g")
    sims = both.withColumns({"there": similarity.jaro_winkler(whole(F.col("f")), whole(F.col("g"))), "back": similarity.jaro_winkler(whole(F.col("g")), whole(F.col("f")))})
    sims = cut(sims.filter(F.greatest("there", "back") >= match.SCAN_LEAST_NAME), "sims")
    weights = scalar.SCORE_WEIGHTS
    free = F.greatest("there", "back") * weights["name"] + weights["dob"] + weights["address"] >= scalar.REVIEW_BAND - 1e-6

    def alike(keys: list[str], wanted: DataFrame) -> DataFrame:
        chunks = match.in_chunks(rows, ["f", "l", *keys], "id", fields)
        a, b = chunks.select("f", "l", *keys, F.col("rows").alias("xs")), chunks.select(F.col("f").alias("g"), "l", *keys, F.col("rows").alias("ys"))
        met = match.unfolded(a.join(wanted, ["f", "l"]).join(b, ["g", "l", *keys]), "there", "back").filter("x.id <> y.id")
        sim = F.when(F.col("x.id") < F.col("y.id"), F.col("there")).otherwise(F.col("back"))
        return met.select(F.least("x.id", "y.id").alias("primary_id"), F.greatest("x.id", "y.id").alias("candidate_id"), sim.alias("name_sim"), "x", "y").filter(F.col("name_sim") >= match.SCAN_LEAST_NAME)

    equal = match.pairs_within(match.in_chunks(rows, ["f", "l"], "id", fields), ["f", "l"]).select(F.least("x.id", "y.id").alias("primary_id"), F.greatest("x.id", "y.id").alias("candidate_id"), F.lit(1.0).alias("name_sim"), "x", "y")
    pairs = equal.unionByName(alike([], sims.filter(free))).unionByName(alike(["p_retailprice"], sims.filter(~free)))
    given = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    dob = F.greatest(F.lit(0.0), 1 - F.abs(F.col("x.p_size") - F.col("y.p_size")) * 73 / F.lit(730.0))
    address, other = given(F.col("x.p_type") == F.col("y.p_type")), given(F.col("x.p_retailprice") == F.col("y.p_retailprice"))
    score = F.when(F.col("x.first") == F.col("y.first"), scalar.exact_name_score(dob, address, other)).otherwise(
        scalar.weighted_score({"name": F.col("name_sim"), "dob": dob, "address": address, "alternate_contact": other})
    )
    return pairs.select("primary_id", "candidate_id", "name_sim", score.alias("score"))


@query(ALL_BRANDS_SQL + f", banded as (select *, {BAND_SQL} as match_type from scored) select primary_id, candidate_id, round(name_sim, 4) as name_sim, round(score, 4) as score, match_type from banded where match_type <> 'low'")
def duplicate_scan_banded(spark, sf_dir):
    # Rounded as the SQL does; Spark's own rounding goes through decimals, which is most of the time of so many pairs.
    rounded = lambda c, digits: F.floor(F.col(c) * 10**digits + 0.5) / 10**digits
    out = scan_all_brands(spark, sf_dir).withColumn("match_type", scalar.band(rounded("score", 9))).filter("match_type <> 'low'")
    return out.select("primary_id", "candidate_id", rounded("name_sim", 4).alias("name_sim"), rounded("score", 4).alias("score"), "match_type")


@query(SCAN_SQL + f"select {BAND_SQL} as match_type, count(*) as n from scored group by 1")
def weighted_score_band(spark, sf_dir):
    return scan(spark, sf_dir).groupBy(scalar.band(F.round("score", 9)).alias("match_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PEOPLE_SQL} select a.id as primary_id, b.id as candidate_id from people a join people b on lower(a.last) = lower(b.last) and left(lower(a.first), 1) = left(lower(b.first), 1) and a.p_brand = b.p_brand and a.id < b.id")
def block_name_initial_pairs(spark, sf_dir):
    rows = people(spark, sf_dir).select("id", "p_brand", F.lower("last").alias("last"), F.substring(F.lower("first"), 1, 1).alias("initial"))
    return match.block_pairs(rows, ["last", "initial", "p_brand"], "id")


ALIKE_SQL = """with names as (select left(md5(cast(c_custkey // 3 as varchar)), 7) || (c_custkey % 3) || ' l' || (c_custkey // 3 % 5) as name, 'l' || (c_custkey // 3 % 5) as last from customer)
select a.name, b.name as near, round(jaro_winkler_similarity(a.name, b.name), 6) as similarity from names a join names b on a.last = b.last and left(a.name, 1) = left(b.name, 1) and a.name < b.name"""


@query(f"{ALIKE_SQL} where jaro_winkler_similarity(a.name, b.name) >= 0.85")
def alike_names(spark, sf_dir):
    """Pairs of nearly equal names, by a join with filters."""
    k = F.floor(F.col("c_custkey") / 3)
    first, last = F.concat(F.left(F.md5(k.cast("string").cast("binary")), F.lit(7)), F.col("c_custkey") % 3), F.concat(F.lit("l"), k % 5)
    names = table(spark, sf_dir, "customer").select(F.concat_ws(" ", first, last).alias("name"), last.alias("last"))
    found = alike.alike_names(names, 0.85)
    return found.select(F.col("a").alias("name"), F.col("b").alias("near"), F.round("similarity", 6).alias("similarity"))


DUPLICATES_SQL = f"""with {PEOPLE_SQL}, p as (select id, lower(first) as f, lower(last) as l, p_size, case when id % 3 = 0 then cast(p_retailprice as varchar) end as mail from people where first <> '' and last <> ''),
pairs as (select a.id as primary_id, b.id as candidate_id, a.f = b.f as same, case when a.f = b.f then 1.0 else jaro_winkler_similarity(a.f || ' ' || a.l, b.f || ' ' || b.l) end as name,
    greatest(0.0, 1 - abs(a.p_size - b.p_size) * 73 / 730.0) as dob, case when a.mail = b.mail then 1.0 else 0.0 end as contact
  from p a join p b on a.l = b.l and left(a.f, 1) = left(b.f, 1) and a.id < b.id),
scored as (select *, case when same then least(1.0, 0.90 + dob * 0.05 + contact * 0.02) else name * 0.25 + dob * 0.20 + contact * 0.20 end as score from pairs where name >= 0.80)
select primary_id, candidate_id, round(name, 4) as name, round(score, 4) as score, case when round(score, 4) >= 0.95 then 'high' else 'review' end as match_type from scored where round(score, 4) >= 0.60"""


@query(DUPLICATES_SQL)
def scan_duplicates(spark, sf_dir):
    """The library's scan over all people: pairs of a block with alike names, scored by name, date of birth and contact."""
    mail = F.when(F.col("id") % 3 == 0, F.col("p_retailprice").cast("string"))
    none = F.lit(None).cast("string")
    rows = people(spark, sf_dir).select(
        F.col("id").alias("person_id"), F.col("first").alias("first_name"), F.col("last").alias("last_name"), F.date_add(F.lit("1950-01-01").cast("date"), (F.col("p_size") * 73).cast("int")).cast("string").alias("dob"),
        *[none.alias(c) for c in ("street", "city", "postal_code", "employer", "school")], F.array(F.concat(mail, F.lit("@x.org"))).alias("emails"), F.array().cast("array<string>").alias("phones"),
    )
    existing = spark.createDataFrame([], "primary_id long, candidate_id long")
    return match.scan_duplicates(rows, existing).select("primary_id", "candidate_id", F.round("name", 4).alias("name"), "score", "match_type")


# weighted_score_band and block_name_initial_pairs also block by brand, as their SQL does. Those below compare people of all brands; their rows are
# classes with counts, so they don't grow with the square of a block.

WHOLE_SQL = SCAN_SQL.replace(" and a.p_brand = b.p_brand", "").replace("select a.id as primary_id, b.id as candidate_id,", "select a.id as primary_id, b.id as candidate_id, a.first as fa, b.first as fb, lower(a.last) as l, a.p_size as sa, b.p_size as sb,").replace(
    "select primary_id, candidate_id, name_sim,", "select fa, fb, l, sa, sb, addr, alt, name_sim,"
)
SWAP_SQL = "fa > fb or (fa = fb and sa > sb)"


def scan_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored classes of pairs (first names, last name, sizes, whether type and price agree) with n, the pairs in each.

    Pairs come from products of counts: joins by name alone, with the type, with the price and with both give the four
    cases by inclusion and exclusion. Each pair is met from either side, and pairs of a row with itself are taken off;
    the similarity of names is the same both ways.
    """
    rows = people(spark, sf_dir).withColumns({"f": F.lower("first"), "l": F.lower("last")})
    names = rows.select("f", "l").distinct()
    both = names.join(names.withColumnRenamed("f", "g"), "l")
    sims = cut(both.withColumn("name_sim", similarity.name_similarity(F.col("f"), F.col("l"), F.col("g"), F.col("l"))).filter(F.col("name_sim") >= match.SCAN_LEAST_NAME), "sims")
    agree = {(): [(0, 0, 1)], ("p_type",): [(1, 0, 1), (0, 0, -1)], ("p_retailprice",): [(0, 1, 1), (0, 0, -1)], ("p_type", "p_retailprice"): [(1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1)]}
    cells = ["l", "name_sim", "fa", "fb", "sa", "sb"]
    own = rows.join(sims.filter("f = g"), ["f", "l"])
    parts = [
        own.select("l", "name_sim", F.col("first").alias("fa"), F.col("first").alias("fb"), F.col("p_size").alias("sa"), F.col("p_size").alias("sb"), F.col("p_type").isNotNull().cast("int").alias("addr"), F.col("p_retailprice").isNotNull().cast("int").alias("alt"), F.lit(-1).cast("long").alias("n"))
    ]
    for keys, signs in agree.items():
        counted = rows.groupBy("f", "l", "first", "p_size", *keys).agg(F.count(F.lit(1)).alias("n"))
        a = counted.select("f", "l", F.col("first").alias("fa"), F.col("p_size").alias("sa"), *keys, F.col("n").alias("na")).join(sims, ["f", "l"])
        b = counted.select(F.col("f").alias("g"), "l", F.col("first").alias("fb"), F.col("p_size").alias("sb"), *keys, F.col("n").alias("nb"))
        sums = a.join(b, ["g", "l", *keys]).groupBy(*cells).agg(F.sum(F.col("na") * F.col("nb")).alias("m"))
        signed = F.explode(F.array(*[F.struct(F.lit(t).alias("addr"), F.lit(p).alias("alt"), F.lit(v).alias("v")) for t, p, v in signs]))
        parts.append(sums.select("*", signed.alias("x")).select(*cells, "x.addr", "x.alt", (F.col("m") * F.col("x.v")).alias("n")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    swap = F.expr(SWAP_SQL)
    sided = found.select("l", "name_sim", *[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("fa", "fb"), ("fb", "fa"), ("sa", "sb"), ("sb", "sa"))], "addr", "alt", "n")
    pairs = sided.groupBy(*cells, "addr", "alt").agg((F.sum("n") / 2).cast("long").alias("n")).filter("n > 0")
    dob = F.greatest(F.lit(0.0), 1 - F.abs(F.col("sa") - F.col("sb")) * 73 / F.lit(730.0))
    address, other = F.col("addr").cast("double"), F.col("alt").cast("double")
    score = F.when(F.col("fa") == F.col("fb"), scalar.exact_name_score(dob, address, other)).otherwise(
        scalar.weighted_score({"name": F.col("name_sim"), "dob": dob, "address": address, "alternate_contact": other})
    )
    return pairs.select("*", score.alias("score"))


@query(
    WHOLE_SQL
    + f""", banded as (select *, {BAND_SQL} as match_type, {SWAP_SQL} as swap from scored)
select case when swap then fb else fa end as first_a, case when swap then fa else fb end as first_b, l as last, case when swap then sb else sa end as size_a, case when swap then sa else sb end as size_b,
  addr = 1 as same_type, alt = 1 as same_price, round(name_sim, 4) as name_sim, round(score, 4) as score, match_type, count(*) as n from banded where match_type <> 'low' group by all"""
)
def duplicate_scan_classes(spark, sf_dir):
    """duplicate_scan_banded over all brands: classes of pairs and how many pairs each holds."""
    out = scan_classes(spark, sf_dir).withColumn("match_type", scalar.band(F.round("score", 9))).filter("match_type <> 'low'")
    sides = [F.col(x).alias(y) for x, y in (("fa", "first_a"), ("fb", "first_b"), ("l", "last"), ("sa", "size_a"), ("sb", "size_b"))]
    return out.select(*sides, (F.col("addr") == 1).alias("same_type"), (F.col("alt") == 1).alias("same_price"), F.round("name_sim", 4).alias("name_sim"), F.round("score", 4).alias("score"), "match_type", "n")


@query(WHOLE_SQL + f"select {BAND_SQL} as match_type, count(*) as n from scored group by 1")
def weighted_score_band_whole(spark, sf_dir):
    """weighted_score_band over all brands."""
    return scan_classes(spark, sf_dir).groupBy(scalar.band(F.round("score", 9)).alias("match_type")).agg(F.sum("n").alias("n"))


@query(f"with {PEOPLE_SQL} select lower(a.last) as last, left(lower(a.first), 1) as initial, count(*) as n_pairs from people a join people b on lower(a.last) = lower(b.last) and left(lower(a.first), 1) = left(lower(b.first), 1) and a.id < b.id group by 1, 2")
def block_name_initial_counts(spark, sf_dir):
    """block_name_initial_pairs over all brands: each block and how many pairs it holds."""
    blocks = people(spark, sf_dir).groupBy(F.lower("last").alias("last"), F.substring(F.lower("first"), 1, 1).alias("initial")).agg(F.count(F.lit(1)).alias("n"))
    return blocks.filter("last is not null and initial is not null and n > 1").select("last", "initial", F.expr("n * (n - 1) div 2").alias("n_pairs"))


@query("with n as (select distinct lower(p_name) as a from part) select x.a as name_a, y.a as name_b, round(jaro_winkler_similarity(x.a, y.a), 6) as sim from n x join n y on x.a < y.a and split_part(x.a, ' ', 2) = split_part(y.a, ' ', 2)")
def jw_name_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name_a")).distinct()
    pairs = names.withColumn("l", F.element_at(F.split("name_a", " "), -1)).join(names.select(F.col("name_a").alias("name_b"), F.element_at(F.split("name_a", " "), -1).alias("l")), "l").filter("name_a < name_b")
    return pairs.select("name_a", "name_b", F.round(similarity.jaro_winkler("name_a", "name_b"), 6).alias("sim"))


@query()
def token_ratio_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    both = rows.alias("a").join(rows.alias("b"), (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_type") < F.col("b.p_type")))
    return both.select(F.col("a.p_type").alias("type_a"), F.col("b.p_type").alias("type_b"), similarity.token_sort_ratio("a.p_type", "b.p_type").alias("ratio"))


# --- contacts in documents ----------------------------------------------------------------------------------------

MAIL = r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*"
PHONE = r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
TOKENS_SQL = f"mails as (select doc_id, unnest(regexp_extract_all(text, '{MAIL}')) as raw from documents), phones as (select doc_id, unnest(regexp_extract_all(text, '{PHONE}')) as raw from documents)"
NORM_MAIL = r"regexp_replace(lower(trim(raw)), '^([^@+]*)\+[^@]*@', '\1@')"
VALID_MAIL = r"regexp_matches(raw, '^[^@\s]+@[^@\s]+\.[^@\s]+$')"
NORM_PHONE = r"regexp_replace(raw, '[ ()-]', '', 'g')"


def tokens(spark, sf_dir, pattern):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("raw"))


@query(f"with {TOKENS_SQL} select count(*) as tokens, count(*) filter (not {VALID_MAIL}) as violations from mails")
def dq_email_format_counts(spark, sf_dir):
    judged = dq.judge(tokens(spark, sf_dir, MAIL).withColumns({"email": F.col("raw"), "phone": F.lit(None).cast("string")}), dq.person_rules())
    return judged.agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("status") == "quarantined").alias("violations"))


@query(rf"with {TOKENS_SQL}, forms as (select 'raw' as form, raw as v from phones union all select 'normalized', {NORM_PHONE} from phones) select form, count(*) as tokens, count(*) filter (not regexp_matches(v, '^\+[1-9][0-9]{{7,14}}$')) as violations from forms group by form")
def dq_phone_e164_counts(spark, sf_dir):
    found = tokens(spark, sf_dir, PHONE)
    forms = F.array(F.struct(F.lit("raw").alias("form"), F.col("raw").alias("phone")), F.struct(F.lit("normalized").alias("form"), scalar.normalize_phone("raw").alias("phone")))
    rows = found.select(F.explode(forms).alias("f")).select("f.*", F.lit(None).cast("string").alias("email"))
    return dq.judge(rows, dq.person_rules()).groupBy("form").agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("status") == "quarantined").alias("violations"))


@query(f"with {TOKENS_SQL} select doc_id, raw, {NORM_MAIL} as email from mails")
def normalize_email_tokens(spark, sf_dir):
    return tokens(spark, sf_dir, MAIL).select("doc_id", "raw", scalar.normalize_email("raw").alias("email"))


@query(f"with {TOKENS_SQL} select doc_id, raw, {NORM_PHONE} as phone from phones")
def normalize_phone_tokens(spark, sf_dir):
    return tokens(spark, sf_dir, PHONE).select("doc_id", "raw", scalar.normalize_phone("raw").alias("phone"))


# --- people with contacts from customers and suppliers -------------------------------------------------------------

CONTACTS_SQL = """
contacts as (select c_custkey as row_id, case when c_custkey % 7 = 0 then null when c_custkey % 4 = 0 then 'Box' || (c_custkey % 90) || '+x@Org.test' else 'box' || (c_custkey % 130) || '@org' || case when c_custkey % 3 = 0 then '' else '.test' end end as email,
  case when c_custkey % 5 = 0 then null when c_custkey % 11 = 0 then '555' else '+1415' || lpad(cast(c_custkey % 170 as varchar), 7, '0') end as phone from customer),
stored as (select s_suppkey as person_id, 'box' || (s_suppkey % 80) || '@org.test' as email, '+1415' || lpad(cast(s_suppkey % 120 as varchar), 7, '0') as phone from supplier)
"""


def contacts(spark, sf_dir):
    k = F.col("c_custkey")
    mail = F.when(k % 7 == 0, None).when(k % 4 == 0, F.concat(F.lit("Box"), k % 90, F.lit("+x@Org.test"))).otherwise(F.concat(F.lit("box"), k % 130, F.lit("@org"), F.when(k % 3 == 0, "").otherwise(".test")))
    phone = F.when(k % 5 == 0, None).when(k % 11 == 0, "555").otherwise(F.concat(F.lit("+1415"), F.lpad((k % 170).cast("string"), 7, "0")))
    return table(spark, sf_dir, "customer").select(k.alias("row_id"), mail.alias("email"), phone.alias("phone"))


def stored(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("person_id"), F.concat(F.lit("box"), k % 80, F.lit("@org.test")).alias("email"), F.concat(F.lit("+1415"), F.lpad((k % 120).cast("string"), 7, "0")).alias("phone"))


RULES_SQL = rf"""
with {CONTACTS_SQL}, v as (
  select row_id, 'VOL_CONTACT_REQUIRED' as rule_code, 'warning' as severity from contacts where email is null and phone is null
  union all select row_id, 'VOL_EMAIL_FORMAT', 'error' from contacts where not regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$')
  union all select row_id, 'VOL_PHONE_E164', 'error' from contacts where not regexp_matches(phone, '^\+[1-9][0-9]{{7,14}}$'))
"""


def judged_contacts(spark, sf_dir):
    return dq.judge(contacts(spark, sf_dir), dq.person_rules(contact_required=True))


@query(RULES_SQL + "select rule_code, count(*) as n from v group by 1")
def dq_rule_summary(spark, sf_dir):
    return dq.rule_counts(dq.violation_log(judged_contacts(spark, sf_dir), F.col("row_id").cast("string"), "volunteer"))


@query(RULES_SQL + "select case when exists (select 1 from v where v.row_id = c.row_id and severity = 'error') then 'quarantined' else 'validated' end as status, count(*) as n from contacts c group by 1")
def dq_status_counts(spark, sf_dir):
    return judged_contacts(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(RULES_SQL + "select row_id, rule_code, severity from v")
def dq_violation_log(spark, sf_dir):
    return dq.violation_log(judged_contacts(spark, sf_dir), F.col("row_id"), "volunteer").select(F.col("record_key").alias("row_id"), "rule_code", "severity")


@query(RULES_SQL + "select row_id from contacts c where not exists (select 1 from v where v.row_id = c.row_id and severity = 'error') and email is not null and row_id % 10 <> 0")
def clean_promotion(spark, sf_dir):
    judged = judged_contacts(spark, sf_dir)
    existing = contacts(spark, sf_dir).filter("row_id % 10 = 0")
    return dq.promote(judged, existing, ["row_id"], ["email"]).select("row_id")


@query(
    rf"""with {CONTACTS_SQL}, n as (select row_id, regexp_replace(lower(email), '^([^@+]*)\+[^@]*@', '\1@') as e, case when phone <> '555' then phone end as p from contacts),
m as (select row_id, person_id, max(em) as em, max(pm) as pm from (
  select row_id, person_id, 1 as em, 0 as pm from n join stored s on n.e = s.email union all select row_id, person_id, 0, 1 from n join stored s on n.p = s.phone) group by 1, 2),
f as (select row_id, sum(em) as ne, sum(pm) as np, count(*) filter (em + pm = 2) as nb, min(case when em + pm = 2 then person_id end) as both_id, min(person_id) as any_id from m group by 1),
o as (select n.row_id, both_id, any_id, case when e is null and p is null then 'insufficient' when coalesce(ne, 0) = 0 and coalesce(np, 0) = 0 then 'none' when nb = 1 then 'combined' when nb > 1 then 'ambiguous'
  when np = 0 and ne = 1 then 'email' when ne = 0 and np = 1 then 'phone' else 'ambiguous' end as outcome from n left join f using (row_id))
select row_id, outcome, case when outcome = 'combined' then both_id when outcome in ('email', 'phone') then any_id end as matched_id from o"""
)
def deterministic_match_outcome(spark, sf_dir):
    return match.match_by_contact(contacts(spark, sf_dir), stored(spark, sf_dir))


@query(
    sql_of("deterministic_match_outcome").replace("n.e = s.email union", "n.e = s.email or (split_part(n.e, '@', 1) <> '' and split_part(n.e, '@', 2) = split_part(s.email, '@', 2) and starts_with(s.email, split_part(n.e, '@', 1))) union")
)
def deterministic_match_with_prefix(spark, sf_dir):
    """deterministic_match_outcome, with stored addresses that begin with the local part in the same domain."""
    return match.match_by_contact(contacts(spark, sf_dir), stored(spark, sf_dir), prefix=True)


def overlaps(rows):
    """Each row against the one 130 ids later: whether they share a normalised address or number."""
    lists = rows.select("row_id", F.array("email").alias("m"), F.array("phone").alias("p"))
    a, b = lists.alias("a"), lists.alias("b")
    both = a.join(b, F.col("b.row_id") == F.col("a.row_id") + 130)
    score = scalar.alternate_contact(F.col("a.m"), F.col("a.p"), F.col("b.m"), F.col("b.p"))
    return both.select(F.col("a.row_id").alias("row_a"), F.col("b.row_id").alias("row_b"), score.alias("overlap"))


@query(rf"""with {CONTACTS_SQL}, t as (select row_id, regexp_replace(lower(email), '^([^@+]*)\+[^@]*@', '\1@') as e, case when phone <> '555' then phone end as p from contacts)
select a.row_id as row_a, b.row_id as row_b, case when coalesce(a.e = b.e, false) or coalesce(a.p = b.p, false) then 1.0 else 0.0 end as overlap from t a join t b on b.row_id = a.row_id + 130""")
def contact_overlap(spark, sf_dir):
    return overlaps(contacts(spark, sf_dir))


@query(rf"""with {CONTACTS_SQL}, t as (select row_id, regexp_replace(lower(email), '^([^@+]*)\+[^@]*@', '\1@') as e, case when phone <> '555' then phone end as p from contacts)
select a.row_id as row_a, b.row_id as row_b, case when coalesce(a.e = b.e, false) or coalesce(a.p = b.p, false) then 1.0 else 0.0 end as overlap from t a join t b on b.row_id = a.row_id + 130""")
def contact_overlap_whole(spark, sf_dir):
    """contact_overlap over all contacts."""
    return overlaps(contacts(spark, sf_dir))


# --- completeness -------------------------------------------------------------------------------------------------

ENTITIES = {
    "customer": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_name", "p_brand", "p_type", "p_size"],
    "documents": ["text", "lang", "source", "n_chars"],
}
NUMBERS = {"c_nationkey", "c_acctbal", "s_nationkey", "s_acctbal", "p_size", "n_chars"}
FIELDS_SQL = "with fields as (" + " union all ".join(
    f"select '{e}' as entity, '{f}' as field, count(*) as total, count(*) filter ({f} is not null and {f} <> {'0' if f in NUMBERS else chr(39) * 2}) as populated from {e}" for e, fs in ENTITIES.items() for f in fs
) + "), pct as (select *, case when total = 0 then 0.0 else cast(populated as double) * 100 / total end as p from fields)"


def all_fields(spark, sf_dir):
    out = None
    for e, fs in ENTITIES.items():
        part = completeness.field_completeness(table(spark, sf_dir, e), fs, zero=True).withColumn("entity", F.lit(e))
        out = part if out is None else out.unionByName(part)
    return out


@query(FIELDS_SQL + " select entity, field, total, populated, round(p, 2) as percent from pct")
def field_completeness_by_entity(spark, sf_dir):
    return all_fields(spark, sf_dir)


@query(FIELDS_SQL + " select entity, max(total) as total, round(avg(round(p, 2)), 2) as completeness from pct group by entity")
def entity_completeness(spark, sf_dir):
    return completeness.entity_completeness(all_fields(spark, sf_dir))


@query(FIELDS_SQL + ", e as (select entity, max(total) as total, round(avg(round(p, 2)), 2) as c from pct group by entity) select round(sum(c * total) / sum(total), 2) as health_score from e")
def health_score(spark, sf_dir):
    return completeness.health_score(completeness.entity_completeness(all_fields(spark, sf_dir)))


@query(FIELDS_SQL + " select entity, field, case when p >= 80 then 'good' when p >= 50 then 'warning' else 'critical' end as status from pct")
def completeness_status(spark, sf_dir):
    return completeness.with_status(all_fields(spark, sf_dir)).select("entity", "field", "status")


@query(
    """with r as (select 'orders' as relation, count(*) as total, count(*) filter (c_custkey in (select o_custkey from orders)) as populated from customer
union all select 'labels', count(*), count(*) filter (doc_id in (select doc_id from labels)) from documents)
select relation, total, populated, round(cast(populated as double) * 100 / total, 2) as percent from r"""
)
def relationship_completeness(spark, sf_dir):
    of = lambda n: table(spark, sf_dir, n)
    a = completeness.relationship_completeness(of("customer"), "c_custkey", {"orders": (of("orders"), "o_custkey")})
    return a.unionByName(completeness.relationship_completeness(of("documents"), "doc_id", {"labels": (of("labels"), "doc_id")}))


@query("with k as (select unnest(json_keys(props)) as key from events union all select 'expected') select key, count(*) filter (key <> 'expected') as populated from k group by key")
def metadata_key_discovery(spark, sf_dir):
    maps = table(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("m"))
    return completeness.metadata_completeness(maps, "m", ["expected"])


@query("select 'c_mktsegment' as field, count(*) as total, count(c_mktsegment) as populated, round(cast(count(c_mktsegment) as double) * 100 / count(*), 2) as percent from customer")
def enabled_fields_only(spark, sf_dir):
    left = completeness.enabled(ENTITIES["customer"], {"c_name", "c_nationkey", "c_acctbal"})
    return completeness.field_completeness(table(spark, sf_dir, "customer"), left)


# --- reports ------------------------------------------------------------------------------------------------------


@query("select case when grouping(o_orderstatus) = 0 then 'o_orderstatus' else 'o_orderpriority' end as dimension, coalesce(o_orderstatus, o_orderpriority) as value, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority))")
def status_stats_grouping_sets(spark, sf_dir):
    return reports.counts_by_each(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("select s.status as o_orderstatus, count(o_orderkey) as n from (values ('F'), ('O'), ('P'), ('X')) s(status) left join orders on o_orderstatus = s.status group by 1")
def run_stats_by_status(spark, sf_dir):
    return reports.counts_of_known(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "P", "X"))


@query("with s as (select event_type as skip_type, case when event_id % 2 = 0 then event_type || ' : ' || props else repeat(event_type, 9) end as r from events) select skip_type, case when contains(r, ':') then trim(split_part(r, ':', 1)) else left(r, 50) end as reason, count(*) as n from s group by 1, 2")
def reason_prefix_summary(spark, sf_dir):
    r = F.when(F.col("event_id") % 2 == 0, F.concat_ws(" : ", "event_type", "props")).otherwise(F.repeat("event_type", 9))
    return reports.skip_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("skip_type"), r.alias("skip_reason")))


AS_OF = "2024-01-30 00:00:00"


@query(f"with a as (select epoch(timestamp '{AS_OF}' - ts) / 3600 as h from events) select case when h < 24 then 'under_24h' when h < 48 then '24h_to_48h' else 'over_48h' end as bucket, count(*) as n from a group by 1")
def aging_buckets(spark, sf_dir):
    at = F.to_timestamp(F.lit(AS_OF))
    return table(spark, sf_dir, "events").groupBy(merge.aging(F.col("ts"), at).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


SUGGESTIONS_SQL = """s as (select event_id as suggestion_id, case when event_id % 9 = 0 then null else user_id end as primary_id, user_id + event_id as candidate_id, round(value, 2) as score,
  case event_id % 4 when 0 then 'auto_merged' when 1 then 'deferred' else 'pending' end as decision, case when event_id % 3 = 0 then 'high' else 'review' end as match_type from events)"""


def queue(spark, sf_dir):
    k = F.col("event_id")
    decision = F.when(k % 4 == 0, "auto_merged").when(k % 4 == 1, "deferred").otherwise("pending")
    return table(spark, sf_dir, "events").select(
        k.alias("suggestion_id"), F.when(k % 9 != 0, F.col("user_id")).alias("primary_id"), (F.col("user_id") + k).alias("candidate_id"), F.round("value", 2).alias("score"), decision.alias("decision"), F.when(k % 3 == 0, "high").otherwise("review").alias("match_type")
    )


@query(f"with {SUGGESTIONS_SQL}, o as (select *, decision = 'pending' and primary_id is not null as open from s) select count(*) filter (open and match_type = 'high') as pending_high, count(*) filter (open and match_type = 'review') as pending_review, count(*) filter (open) as pending_total, count(*) filter (decision = 'auto_merged') as auto_merged from o")
def queue_stats(spark, sf_dir):
    return merge.queue_stats(queue(spark, sf_dir))


@query(f"with {SUGGESTIONS_SQL} select suggestion_id, score from s where decision = 'pending' and primary_id is not null and match_type = 'high' order by score desc nulls last, suggestion_id limit 50")
def auto_merge_batch(spark, sf_dir):
    return merge.auto_merge_batch(queue(spark, sf_dir)).select("suggestion_id", "score")


@query(f"with {SUGGESTIONS_SQL} select suggestion_id, case when suggestion_id % 5 = 0 and decision in ('pending', 'deferred') then 'rejected' else decision end as decision from s")
def reject_candidates(spark, sf_dir):
    rows = queue(spark, sf_dir)
    return merge.reject(rows, rows.filter("suggestion_id % 5 = 0").select("suggestion_id")).select("suggestion_id", "decision")


@query("select l_suppkey as owner, sum(l_quantity) as hours, count(*) as sessions, min(cast(l_shipdate as date)) as first_day, max(cast(l_shipdate as date)) as last_day from lineitem group by 1")
def hours_by_owner(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_quantity").alias("hours"), F.to_date("l_shipdate").alias("day"))
    return reports.hours_by(rows, "owner")


@query("select n_name, coalesce(sum(l_quantity), 0.0) as hours from nation left join (supplier join lineitem on s_suppkey = l_suppkey) on n_nationkey = s_nationkey group by 1")
def hours_by_org(spark, sf_dir):
    of = lambda n: table(spark, sf_dir, n)
    by = of("lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("h"))
    per = of("supplier").join(by, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("s_nationkey").agg(F.sum("h").alias("hours"))
    return of("nation").join(per, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("hours", F.lit(0.0)).alias("hours"))


STATS_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(" union all ".join(f"select '{f}' as field, count(*) as total, count(*) - count({f}) as nulls, count(distinct {f}) as distinct_values, cast(min({f}) as varchar) as min_value, cast(max({f}) as varchar) as max_value, {f'round(avg({f}), 4)' if f.endswith('key') else 'null::double'} as avg_value from orders" for f in STATS_FIELDS))
def field_statistics(spark, sf_dir):
    return sampling.field_statistics(table(spark, sf_dir, "orders"), STATS_FIELDS)


@query("select p_type as value, count(*) as n from part group by 1 order by n desc, value limit 10")
def top10_values(spark, sf_dir):
    return sampling.top_values(table(spark, sf_dir, "part"), "p_type")


@query("select o_orderkey, o_orderpriority, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50")
def page_sorted(spark, sf_dir):
    allowed = {"price": "o_totalprice", "date": "o_orderdate"}
    return reports.sorted_page(table(spark, sf_dir, "orders"), "-price", allowed, "o_orderkey", 3, 25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("with a as (select o_custkey % 10 as run_id, count(*) as staged, count(*) filter (o_orderstatus <> 'P') as clean, count(*) filter (o_orderpriority like '1%') as skipped from orders group by 1), q as (select run_id, greatest(staged, clean) as attempted, skipped from a), u as (select * from q union all select null, cast(sum(attempted) as bigint), cast(sum(skipped) as bigint) from q) select run_id, attempted, skipped, attempted - skipped as matched, round((attempted - skipped) / cast(attempted as double), 4) as match_rate from u")
def affiliation_match_quality(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("run_id", F.col("o_custkey") % 10)
    return reports.match_quality(rows, rows.filter("o_orderstatus <> 'P'"), rows.filter("o_orderpriority like '1%'"))


# --- search, scope, children --------------------------------------------------------------------------------------


@query("select c_custkey from customer where c_name ilike '%00_7%' or c_mktsegment ilike '%build%' or c_custkey in (select o_custkey from orders where o_orderpriority ilike '%urgent%')")
def multi_search_exists(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    a = search.multi_search(customers, "c_custkey", "build", ["c_mktsegment"], []).select("c_custkey")
    b = search.multi_search(customers, "c_custkey", "00_7", ["c_name"], []).select("c_custkey")
    c = search.multi_search(customers, "c_custkey", "urgent", [], [(orders, "o_custkey", "o_orderpriority")]).select("c_custkey")
    return a.unionByName(b).unionByName(c).distinct()


@query("select c_custkey, c_name, (select min_by(o_totalprice, o_orderkey) from orders where o_custkey = c_custkey and o_orderstatus = 'F') as o_totalprice from customer")
def primary_child_left_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("is_primary", F.col("o_orderstatus") == "F")
    return search.with_primary(table(spark, sf_dir, "customer"), "c_custkey", orders, "o_custkey", "o_totalprice", "is_primary", "o_orderkey").select("c_custkey", "c_name", "o_totalprice")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def missing_child_anti(spark, sf_dir):
    return search.without_child(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey").select("c_custkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P') or c_nationkey = 3")
def scope_semi_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    linked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return search.in_scope(customers, "c_custkey", (linked, "o_custkey"), (customers.filter("c_nationkey = 3"), "c_custkey")).select("c_custkey")


@query("with k as (select user_id, event_id, value >= 50 as active, ts from events), r as (select *, row_number() over (partition by user_id order by active desc, ts desc, event_id desc) as rn from k) select user_id, event_id as entity_id, case when active then 'update' else 'reactivate' end as action from r where rn = 1")
def latest_active_map(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.lit("volunteer").alias("entity_type"), F.lit("crm").alias("external_system"), F.col("user_id").cast("string").alias("external_id")
    id_map = events.select(*kind, F.col("event_id").alias("entity_id"), F.col("event_id").alias("map_id"), (F.col("value") >= 50).alias("is_active"), F.col("ts").alias("last_seen_at"))
    incoming = events.select(*kind, "user_id").distinct()
    return match.resolve_id_map(incoming, id_map).select("user_id", "entity_id", "action")


@query("select o_orderkey, o_custkey, o_orderkey = max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) over (partition by o_custkey) as is_primary from orders")
def single_primary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return load.single_primary(rows, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_custkey", "is_primary")


# --- dates, picklists, text ---------------------------------------------------------------------------------------


@query("select a.o_orderkey, round(greatest(0.0, 1 - abs(datediff('day', cast(b.o_orderdate as date), cast(a.o_orderdate as date))) / 730.0), 4) as proximity from orders a join orders b on b.o_orderkey = a.o_orderkey + 1")
def dob_proximity(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    both = rows.alias("a").join(rows.alias("b"), F.col("b.o_orderkey") == F.col("a.o_orderkey") + 1)
    return both.select(F.col("a.o_orderkey").alias("o_orderkey"), F.round(scalar.dob_proximity(F.col("a.d"), F.col("b.d")), 4).alias("proximity"))


@query("with a as (select o_orderkey, cast(o_orderdate as date) - cast((o_custkey % 90) * 365 as integer) as birth from orders), y as (select o_orderkey, cast(date_part('year', age(date '2024-01-31', birth)) as bigint) as years from a) select case when years <= 12 then 'child' when years <= 17 then 'teen' when years <= 64 then 'adult' else 'senior' end as age_group, count(*) as n from y group by 1")
def age_group_bands(spark, sf_dir):
    birth = F.date_sub(F.to_date("o_orderdate"), ((F.col("o_custkey") % 90) * 365).cast("int"))
    rows = table(spark, sf_dir, "orders").select(birth.alias("birth"))
    group = scalar.age_group(scalar.age("birth", F.to_date(F.lit("2024-01-31"))))
    return rows.groupBy(group.alias("age_group")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, cast(trunc(value * 90 / 60) as bigint) as minutes from events")
def event_duration(spark, sf_dir):
    seconds = F.floor(F.col("value") * 90)
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("start"), F.timestamp_seconds(F.unix_timestamp("ts") + seconds).alias("end"))
    return rows.select("event_id", scalar.duration_minutes(F.col("start"), F.col("end")).alias("minutes"))


@query("with e as (select event_id, ts as s, case when event_id % 2 = 0 then ts + interval 3 hour end as e, case when event_id % 3 = 0 then ts - interval 2 day end as d, timestamp '2024-01-15 12:00:00' as now from events) select event_id, coalesce(e, s) < now as is_past, s > now as is_upcoming, cast(s as date) = cast(now as date) or cast(coalesce(e, s) as date) = cast(now as date) as is_today, now < coalesce(d, s) as can_register from e")
def temporal_state(spark, sf_dir):
    k, s = F.col("event_id"), F.col("ts")
    end = F.when(k % 2 == 0, s + F.expr("interval 3 hours"))
    deadline = F.when(k % 3 == 0, s - F.expr("interval 2 days"))
    state = scalar.temporal_state(s, end, deadline, F.to_timestamp(F.lit("2024-01-15 12:00:00")))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in state.items()])


def picklist_sql(text: str, table_: list[tuple[str, str]], default: str | None = None) -> str:
    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    keys = picklists.keys_of(table_)
    exact = " ".join(f"when {text} = {quote(k)} then {quote(v)}" for k, v in reversed(dict(keys).items()))
    part = " ".join(f"when contains({text}, {quote(k)}) or contains({quote(k)}, {text}) then {quote(v)}" for k, v in keys)
    return f"case when {text} is null or {text} = '' then null {exact} {part} else {quote(default)} end"


@query(f"select distinct p_type, {picklist_sql('lower(p_type)', picklists.ORGANIZATION_TYPE, 'other')} as organization_type, {picklist_sql('lower(p_type)', picklists.RACE)} as race, {picklist_sql('lower(p_type)', picklists.EDUCATION)} as education from part")
def picklist_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_type").distinct()
    return rows.select("p_type", picklists.normalize_organization_type("p_type").alias("organization_type"), picklists.normalize_race_ethnicity("p_type").alias("race"), picklists.normalize_education_level("p_type").alias("education"))


@query(f"select distinct event_type, {picklist_sql('lower(event_type)', picklists.SESSION_TYPE, 'other')} as session_type, {picklist_sql('lower(event_type)', picklists.SESSION_STATUS, 'requested')} as session_status, {picklist_sql('lower(event_type)', picklists.EVENT_FORMAT, 'in_person')} as event_format, {picklist_sql('lower(event_type)', picklists.CANCELLATION, 'other')} as cancellation from events")
def picklist_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type").distinct()
    return rows.select("event_type", picklists.normalize_session_type("event_type").alias("session_type"), picklists.normalize_session_status("event_type").alias("session_status"), picklists.normalize_event_format("event_type").alias("event_format"), picklists.normalize_cancellation_reason("event_type").alias("cancellation"))


@query(r"with b as (select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[_\s]+', '-', 'g'), '[^a-z0-9-]', '', 'g') as base from part), n as (select *, row_number() over (partition by base order by p_partkey) - 1 as k from b) select p_partkey, case when k = 0 then base else base || '-' || k end as slug from n")
def slug_unique(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", scalar.slugify("p_name").alias("base"))
    return load.unique_slugs(rows, "base", "p_partkey").select("p_partkey", "slug")


@query(r"with d as (select doc_id, case doc_id % 4 when 0 then '=' when 1 then '-' else '' end || lang || source as t from documents) select doc_id, case when left(t, 1) in ('=', '+', '-', '@') then '''' || t else t end as t from d")
def csv_guard_export(spark, sf_dir):
    t = F.concat(F.when(F.col("doc_id") % 4 == 0, "=").when(F.col("doc_id") % 4 == 1, "-").otherwise(""), "lang", "source")
    return guarded(table(spark, sf_dir, "documents").select("doc_id", t.alias("t")))


# --- loads, survivorship, merges ----------------------------------------------------------------------------------

SURVIVORS_SQL = """w as (select c_custkey as k, case when c_custkey % 5 = 0 then 'hand' || c_custkey end as m, case when c_custkey % 3 = 0 then '' else s_name end as i, c_name as x from customer left join supplier on s_suppkey = c_custkey),
d as (select k, coalesce(nullif(trim(m), ''), nullif(trim(i), ''), nullif(trim(x), '')) as value, case when nullif(trim(m), '') is not null then 'manual' when nullif(trim(i), '') is not null then 'incoming' when nullif(trim(x), '') is not null then 'existing_core' else 'manual' end as tier, x from w)"""


def survivors(spark, sf_dir):
    k = F.col("c_custkey")
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == k, "left")
    rows = joined.select(k.alias("k"), F.when(k % 5 == 0, F.concat(F.lit("hand"), k)).alias("manual_first_name"), F.when(k % 3 == 0, "").otherwise(F.col("s_name")).alias("incoming_first_name"), F.col("c_name").alias("existing_core_first_name"))
    return survivorship.apply_survivorship(rows, keep=("k",))


@query(f"with {SURVIVORS_SQL} select k, value, tier, value is distinct from x as changed from d")
def survivorship_winner(spark, sf_dir):
    return survivors(spark, sf_dir).select("k", "first_name.*")


@query(f"with {SURVIVORS_SQL}, c as (select *, value is distinct from x as changed from d) select 'identity' as field_group, count(*) as total, count(*) filter (changed) as changed, count(*) filter (changed and tier = 'manual') as manual_wins, count(*) filter (changed and tier = 'incoming') as incoming_overrides from c")
def survivorship_stats(spark, sf_dir):
    return survivorship.survivorship_stats(survivorship.decisions(survivors(spark, sf_dir), ("k",)))


def snapshot(spark, sf_dir, changed: bool):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    if changed:
        k = F.col("c_custkey")
        rows = rows.filter(k % 11 != 0).withColumns({"c_name": F.when(k % 5 == 0, F.concat("c_name", F.lit("*"))).otherwise(F.col("c_name")), "c_mktsegment": F.when(k % 10 == 0, None).otherwise(F.col("c_mktsegment"))})
        more = rows.filter(k % 13 == 0).withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000)
        rows = rows.unionByName(more)
    return rows.withColumn("hash", scalar.checksum({c: F.col(c) for c in ("c_name", "c_mktsegment", "c_nationkey")}))


@query("select 'unchanged' as action, count(*) as n from customer")
def idempotent_replay_actions(spark, sf_dir):
    rows = snapshot(spark, sf_dir, False)
    return load.upsert(rows, rows, "c_custkey").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("with a as (select case when c_custkey % 11 = 0 then 'kept' when c_custkey % 17 = 0 then 'deleted' when c_custkey % 5 = 0 then 'updated' else 'unchanged' end as action from customer union all select 'created' from customer where c_custkey % 11 <> 0 and c_custkey % 13 = 0) select action, count(*) as n from a group by 1")
def upsert_actions(spark, sf_dir):
    incoming = snapshot(spark, sf_dir, True).withColumn("gone", (F.col("c_custkey") % 17 == 0) & (F.col("c_custkey") < 1_000_000_000))
    return load.upsert(snapshot(spark, sf_dir, False), incoming, "c_custkey", "gone").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, 'c_name' as field, c_name as old_value, c_name || '*' as new_value from customer where c_custkey % 11 <> 0 and c_custkey % 5 = 0 union all select c_custkey, 'c_mktsegment', c_mktsegment, null from customer where c_custkey % 11 <> 0 and c_custkey % 10 = 0")
def change_log_explode(spark, sf_dir):
    return load.change_log(snapshot(spark, sf_dir, False), snapshot(spark, sf_dir, True), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query("select o_orderkey, case when o_custkey % 3 = 0 then 'contact_id is not known' else 'organization_id is not known' end as message from orders where o_custkey % 3 = 0 union all select o_orderkey, 'organization_id is not known' from orders where o_custkey % 3 = 0 and o_custkey % 7 = 0 union all select o_orderkey, 'organization_id is not known' from orders where o_custkey % 3 <> 0 and o_custkey % 7 = 0 and false")
def reference_violations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").cast("string").alias("contact_id"), F.col("o_custkey").cast("string").alias("organization_id"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("external_id"), (F.col("c_custkey") % 3 != 0).alias("contact"), ((F.col("c_custkey") % 7 != 0) | (F.col("c_custkey") % 3 != 0)).alias("organization"))
    id_map = ids.select("external_id", F.explode(F.create_map(F.lit("contact"), "contact", F.lit("organization"), "organization")).alias("entity_type", "is_active"))
    refs = {"contact_id": "contact", "organization_id": "organization"}
    judged = dq.judge(dq.with_references(orders, id_map, refs), dq.reference_rules(refs))
    return dq.violation_log(judged, F.col("o_orderkey"), "affiliation").select(F.col("record_key").alias("o_orderkey"), "message")


@query("select p_partkey as person_id, case when p_partkey % 10 = 1 then coalesce(nullif(trim(case when p_partkey % 20 = 1 then '' else p_name end), ''), (select p_name from part q where q.p_partkey = part.p_partkey + 1)) else case when p_partkey % 20 = 1 then '' else p_name end end as first_name from part where p_partkey % 10 <> 2 or p_partkey = 2 and not exists (select 1 from part q where q.p_partkey = 1)")
def merge_execution(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("person_id"), F.when(k % 20 == 1, "").otherwise(F.col("p_name")).alias("first_name"))
    pairs = rows.filter("person_id % 10 = 2").select(F.col("person_id").alias("suggestion_id"), (F.col("person_id") - 1).alias("primary_id"), F.col("person_id").alias("candidate_id"))
    return merge.merge_people(rows, pairs)[0]


@query("select p_partkey as person_id, p_name as first_name from part")
def merge_and_undo(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("first_name"))
    pairs = rows.filter("person_id % 10 = 2").select(F.col("person_id").alias("suggestion_id"), (F.col("person_id") - 1).alias("primary_id"), F.col("person_id").alias("candidate_id"))
    after, log = merge.merge_people(rows, pairs)
    return merge.undo_merge(after, log)


SPEC = mapping.Spec.of(
    "customers",
    [
        {"target": "name.full", "source": "c_name", "required": True},
        {"target": "name.short", "source": "c_short", "default": "n/a"},
        {"target": "segment", "source": "c_mktsegment", "transform": "normalize_organization_type"},
        {"target": "active", "source": "c_flag", "default": False},
    ],
)


def mapped_customers(spark, sf_dir):
    k = F.col("c_custkey")
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 9 != 0, F.col("c_name")).alias("c_name"), F.when(k % 2 == 0, " ").otherwise(F.substring("c_name", 1, 4)).alias("c_short"), "c_mktsegment", F.when(k % 3 == 0, "Yes").alias("c_flag"), F.when(k % 4 == 0, "x").alias("c_more"))
    return raw


@query(f"select c_custkey, case when c_custkey % 9 <> 0 then c_name end as full_name, case when c_custkey % 2 = 0 then 'n/a' else left(c_name, 4) end as short_name, {picklist_sql('lower(c_mktsegment)', picklists.ORGANIZATION_TYPE, 'other')} as segment, c_custkey % 3 = 0 as active, cast(case when c_custkey % 9 = 0 then 1 else 0 end as bigint) as n_errors, cast(case when c_custkey % 4 = 0 then 1 else 0 end as bigint) as n_unmapped from customer")
def mapping_compiled(spark, sf_dir):
    done = mapping.apply_mapping(mapped_customers(spark, sf_dir), SPEC, ("c_custkey",))
    return done.select("c_custkey", F.col("name.full").alias("full_name"), F.col("name.short").alias("short_name"), "segment", "active", F.size("errors").cast("long").alias("n_errors"), F.size("unmapped").cast("long").alias("n_unmapped"))


@query("""with r as (select *, case when c_custkey % 9 <> 0 then c_name end as a, case when c_custkey % 2 = 1 then left(c_name, 4) end as b, case when c_custkey % 3 = 0 then 'Yes' end as d from customer)
select 'c_name' as source, 'name.full' as target, count(*) as records, count(a) as populated, cast(0 as bigint) as defaulted, count(*) - count(a) as missing_required, round(count(a) / cast(count(*) as double), 4) as population_rate from r
union all select 'c_short', 'name.short', count(*), count(b), count(*) - count(b), 0, round(count(b) / cast(count(*) as double), 4) from r
union all select 'c_mktsegment', 'segment', count(*), count(c_mktsegment), 0, 0, round(count(c_mktsegment) / cast(count(*) as double), 4) from r
union all select 'c_flag', 'active', count(*), count(d), count(*) - count(d), 0, round(count(d) / cast(count(*) as double), 4) from r""")
def field_import_stats(spark, sf_dir):
    return mapping.field_stats(mapped_customers(spark, sf_dir), SPEC)


PROBE_SQL = "list_distinct([x.p for x in keys if x.k = '{kind}' and x.v = w.{kind}])"
LOAD_SQL = rf"""with recursive {CONTACTS_SQL.strip()}, w as (select row_number() over (order by row_id) as i, row_id as id, nullif(regexp_replace(lower(trim(email)), '^([^@+]*)\+[^@]*@', '\1@'), '') as mail, case when phone <> '555' then phone end as phone,
  'p' || (row_id % 400) as name, row_id % 6 = 0 as mapped, row_id % 12 = 0 as active from contacts),
st(i, id, load_action, skip_reason, entity_id, ambiguous, keys) as (
  select cast(0 as bigint), cast(null as bigint), '', '', cast(null as bigint), false, (select list({{'k': k, 'v': v, 'p': person_id}}) from (select 'mail' as k, email as v, person_id from stored union all select 'phone', phone, person_id from stored union all select 'name', 's' || person_id, person_id from stored))
  union all
  select i, id, action, case when action = 'skipped_duplicate' then case when len(e) > 0 then 'DUPLICATE_EMAIL' else 'DUPLICATE_NAME' end end, case when action = 'inserted' then new_id when action in ('updated', 'reactivated') then 1 when hit is not null then hit when len(e) > 0 then list_min(e) else list_min(n) end,
    action in ('skipped_duplicate', 'inserted') and len(e) + len(p) > 0,
    case when action = 'inserted' then list_concat(keys, [x for x in [{{'k': 'mail', 'v': mail, 'p': new_id}}, {{'k': 'phone', 'v': phone, 'p': new_id}}, {{'k': 'name', 'v': name, 'p': new_id}}] if x.v is not null])
      when action = 'skipped_duplicate' and len(e) = 0 and mail is not null then list_append(keys, {{'k': 'mail', 'v': mail, 'p': list_min(n)}}) else keys end
  from (select *, case when mapped then case when active then 'updated' else 'reactivated' end when hit is not null then 'deterministic_update' when len(e) > 0 or len(n) > 0 then 'skipped_duplicate' else 'inserted' end as action
    from (select *, case when len(list_intersect(e, p)) = 1 then list_intersect(e, p)[1] when len(list_intersect(e, p)) = 0 and len(e) + len(p) = 1 then list_concat(e, p)[1] end as hit
      from (select w.*, keys, id_base + w.id as new_id, {PROBE_SQL.format(kind='mail')} as e, {PROBE_SQL.format(kind='phone')} as p, {PROBE_SQL.format(kind='name')} as n from st join w on w.i = st.i + 1, (select max(person_id) as id_base from stored)))))
select id as clean_id, load_action, skip_reason, entity_id, ambiguous from st where i > 0"""


# The same with names that are nearly alike: four of each kind, and a last name.
NEAR_NAME_SQL = "left(md5(cast((row_id % 400) // 4 as varchar)), 8) || (row_id % 4) || ' l' || ((row_id % 400) // 4 % 5)"
NEAR_PROBE = "[x.p for x in keys if x.k = 'name' and x.v <> w.name and split_part(x.v, ' ', 2) = split_part(w.name, ' ', 2) and left(x.v, 1) = left(w.name, 1) and jaro_winkler_similarity(x.v, w.name) >= 0.95]"
LOAD_NEAR_SQL = (
    LOAD_SQL.replace("'p' || (row_id % 400) as name", f"{NEAR_NAME_SQL} as name")
    .replace("'s' || person_id, person_id from stored", "'s' || person_id || ' l0', person_id from stored")
    .replace(f"{PROBE_SQL.format(kind='name')} as n", f"{PROBE_SQL.format(kind='name')} as n, {NEAR_PROBE} as f")
    .replace("then 'skipped_duplicate' else 'inserted' end as action", "then 'skipped_duplicate' when len(f) > 0 then 'skipped_duplicate_fuzzy' else 'inserted' end as action")
    .replace("case when action = 'skipped_duplicate' then case", "case when action = 'skipped_duplicate_fuzzy' then 'DUPLICATE_FUZZY' when action = 'skipped_duplicate' then case")
    .replace("else list_min(n) end,", "when len(n) > 0 then list_min(n) else list_min(f) end,")
    .replace("action in ('skipped_duplicate', 'inserted')", "action in ('skipped_duplicate', 'skipped_duplicate_fuzzy', 'inserted')")
)


def loaded_contacts(spark, sf_dir):
    rows = contacts(spark, sf_dir).select(F.col("row_id").alias("clean_id"), F.lit("crm").alias("external_system"), F.col("row_id").cast("string").alias("external_id"), scalar.normalize_email("email").alias("mail"), scalar.normalize_phone("phone").alias("phone"), F.concat(F.lit("p"), F.col("row_id") % 400).alias("name"))
    core = stored(spark, sf_dir).select("person_id", F.col("email").alias("mail"), "phone", F.concat(F.lit("s"), "person_id").alias("name"))
    id_map = rows.filter("clean_id % 6 = 0").select("external_system", "external_id", F.lit(1).cast("long").alias("entity_id"), (F.col("clean_id") % 12 == 0).alias("is_active"))
    return load.decide_loads(rows, core, id_map)


@query(LOAD_SQL)
def load_decisions(spark, sf_dir):
    """Rows of one run that meet the core and each other; the SQL goes row by row."""
    return loaded_contacts(spark, sf_dir).select("clean_id", "load_action", "skip_reason", "entity_id", "ambiguous")


@query(LOAD_NEAR_SQL)
def load_decisions_near_names(spark, sf_dir):
    """The same with last names, so that rows meet names that are nearly theirs."""
    k = F.floor(F.col("row_id") % 400 / 4)
    name = F.concat(F.left(F.md5(k.cast("string").cast("binary")), F.lit(8)), F.col("row_id") % 4, F.lit(" l"), k % 5)
    last = F.split("name", " ")[1].alias("last")
    rows = contacts(spark, sf_dir).select(F.col("row_id").alias("clean_id"), F.lit("crm").alias("external_system"), F.col("row_id").cast("string").alias("external_id"), scalar.normalize_email("email").alias("mail"), scalar.normalize_phone("phone").alias("phone"), name.alias("name")).select("*", last)
    core = stored(spark, sf_dir).select("person_id", F.col("email").alias("mail"), "phone", F.concat(F.lit("s"), "person_id", F.lit(" l0")).alias("name")).select("*", last)
    id_map = rows.filter("clean_id % 6 = 0").select("external_system", "external_id", F.lit(1).cast("long").alias("entity_id"), (F.col("clean_id") % 12 == 0).alias("is_active"))
    return load.decide_loads(rows, core, id_map).select("clean_id", "load_action", "skip_reason", "entity_id", "ambiguous")


@query(LOAD_SQL.rsplit("select id as clean_id", 1)[0] + """select count(*) as rows_processed, count(*) filter (load_action = 'inserted') as rows_created, count(*) filter (load_action in ('updated', 'deterministic_update')) as rows_updated, count(*) filter (load_action = 'reactivated') as rows_reactivated,
  cast(0 as bigint) as rows_skipped_no_change, count(*) filter (load_action = 'skipped_duplicate') as rows_skipped_duplicates, count(*) filter (load_action = 'deterministic_update') as rows_deduped_auto, cast(0 as bigint) as rows_missing_external_id,
  count(*) filter (load_action = 'inserted') as potential_inserts, count(distinct w.mail) filter (skip_reason = 'DUPLICATE_EMAIL') as duplicate_emails from st join w using (id) where st.i > 0""")
def load_counters(spark, sf_dir):
    return load.load_summary(loaded_contacts(spark, sf_dir))


# --- increments and samples ---------------------------------------------------------------------------------------


@query("select event_type, count(*) as n, max(ts) as high_water from events where ts > timestamp '2024-01-20 00:00:00' group by 1")
def incremental_since_watermark(spark, sf_dir):
    import datetime

    rows = after_mark(table(spark, sf_dir, "events"), "ts", datetime.datetime(2024, 1, 20))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("high_water"))


@query("with e as (select event_id, case when event_id % 4 = 0 then '' else event_type end as place, ts, ts + cast((value - 20) as integer) * interval 1 minute as e from events), r as (select event_id, (place = '')::int as a, (e < ts)::int as b from e where place = '' or e < ts) select event_id, concat_ws('; ', case when a = 1 then 'Missing all location information' end, case when b = 1 then 'End date before start date' end) as reasons from r order by a + b desc, event_id limit 20")
def edge_case_reasons(spark, sf_dir):
    k = F.col("event_id")
    minutes = F.bround(F.col("value") - 20, 0).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, "").otherwise(F.col("event_type")).alias("place"), "ts", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + minutes * 60_000_000).alias("end"))
    checks = sampling.event_checks([F.col("place")], F.col("ts"), F.col("end"), F.to_timestamp(F.lit(AS_OF)))
    found = sampling.edge_cases(rows.withColumn("reasons", sampling.edge_reasons(checks)), "event_id")
    return found.select("event_id", F.array_join("reasons", "; ").alias("reasons"))


@query("with l as (select doc_id, case when n_chars > 3000 then 'high' when n_chars > 1000 then 'medium' else 'low' end as level from documents), r as (select *, row_number() over (partition by level order by md5('7:' || coalesce(cast(doc_id as varchar), '')), doc_id) as rn from l) select doc_id, level from r where rn <= case level when 'low' then 16 else 17 end")
def stratified_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("level", F.when(F.col("n_chars") > 3000, "high").when(F.col("n_chars") > 1000, "medium").otherwise("low"))
    return sampling.stratified(rows.select("doc_id", "level"), "level", {"high": 17, "medium": 17, "low": 16}, "doc_id", 7)


@query("with c as (select lang, source, count(*) as n from documents group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, source) as rn from c) select lang, source, n from r where rn <= 3")
def top_sources_by_language(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "source")
    return counts.withColumn("rn", F.row_number().over(order)).filter("rn <= 3").drop("rn")


# The queries of the services and of the CRM loaders register themselves.
from kinfold import queries_crm, queries_increments, queries_profiles, queries_records, queries_services  # noqa: E402, F401
