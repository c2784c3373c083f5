"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets counts. Mergeable quantile sketches (approx_percentile keeps a Greenwald-Khanna summary per task and
merges them) of the derived rates per language and source give fences in place of fixed cutoffs: so many times as far
from the group's median as its own outer quantiles. The sketches of small groups lean on those of their language, and
these on the whole. The texts are then filtered by a join with the fences of their own group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import WHITE, WHITE_CLASS, cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
ACCURACY = 10_000
#: Rates as (numerator, denominator) counts, and whether too little of them is odd as well.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", False),
    "upper_rate": ("n_upper", "n_letters", False),
    "dup_line_rate": ("n_dup_lines", "n_lines", False),
    "repeat_rate": ("n_repeat_words", "n_words", False),
    "mark_rate": ("n_marks", "n_words", False),
    "mean_word": ("word_chars", "n_words", True),
    "length": ("n_words", None, True),
}
#: The outer quantiles of a group (log of the words for length), and how many times their distance from the median is normal.
OUTER, REACH = 0.1, 4.0
#: A group's quantiles count as its rows, those of the group around it as so many.
PARENT_ROWS = 200
#: A text may pass a fence by so many standard deviations of a count of its size.
DEVIATIONS = 3.0


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where `use` needs it inside lambdas."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return let(pairs, count)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(n < 4, 0).otherwise(some)


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The counts of every whole text (null: none) with its id and group columns."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    flat = F.trim(F.regexp_replace(t, WHITE_CLASS + "+", " "))
    words = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))
    solid = F.translate(t, WHITE, "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD_PATTERN_SEARCH))
    letters = F.length(F.regexp_replace(t, r"\P{L}+", ""))
    upper = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    counted = docs.select(
        F.col(id_col).alias("id"),
        *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)],
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        letters.cast("long").alias("n_letters"),
        upper.cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!?", ""))).cast("long").alias("n_marks"),
    )
    return counted.select(
        "id", *[f"g{i}" for i in range(len(group_cols))], "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_letters", "n_upper", "n_marks"
    )


#: A line that has a word.
WORD_PATTERN_SEARCH = r"[^\x20\x09-\x0D]"


def _rates(counts: DataFrame) -> DataFrame:
    def value(top: str, below: str | None) -> Column:
        if below is None:
            return F.log1p(F.col(top).cast("double"))
        return F.coalesce(F.try_divide(F.col(top).cast("double"), F.col(below)), F.lit(0.0))

    return counts.withColumns({r: value(top, below) for r, (top, below, _) in RATES.items()})


def adaptive_sketches(rates: DataFrame, groups: list[str]) -> DataFrame:
    """Per group (all its columns; then without the last; ...; then the whole): level, n, and of each rate its low, middle and high quantile."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.percentile_approx(r, F.array(F.lit(OUTER), F.lit(0.5), F.lit(1 - OUTER)), ACCURACY).alias(r) for r in RATES]
    return rates.rollup(*groups).agg(F.grouping_id().alias("level"), *aggs) if groups else rates.agg(F.lit(0).alias("level"), *aggs)


def leaning(own: str, n: Column, parent: str, rate: str) -> Column:
    """The quantiles of a group, drawn to those of the group around it the more the fewer rows it has."""
    return F.zip_with(F.col(f"{own}.{rate}"), F.col(f"{parent}.{rate}"), lambda a, b: (n * a + PARENT_ROWS * b) / (n + PARENT_ROWS))


def fences(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Per full group one row: its columns and an array (low, middle, high) a rate, each level drawn to the one around it."""
    done = sketches.filter(F.col("level") == 2 ** len(groups) - 1).select(*RATES)  # one row at most
    for depth in range(1, len(groups) + 1):
        own, level = groups[:depth], 2 ** (len(groups) - depth) - 1
        on = F.lit(True)
        for c in own[:-1]:
            on = on & F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}"))
        here = sketches.filter(F.col("level") == level).alias("o").join(done.alias("p"), on)
        done = here.select(*[F.col(f"o.{c}").alias(c) for c in own], *[leaning("o", F.col("o.n"), "p", r).alias(r) for r in RATES])
    return done


def within(rate: str, low: Column, middle: Column, high: Column) -> Column:
    """Whether a text's count is one that the fences of its group allow, with the noise of a count of its size."""
    top, below, two_sided = RATES[rate]
    most, least = middle + REACH * (high - middle), F.greatest(middle - REACH * (middle - low), F.lit(0.0))
    if below is None:
        return (F.col(rate) <= most) & (F.col(rate) >= least)
    noise = lambda fence: DEVIATIONS * F.sqrt(F.col(below) * fence + 1)
    ok = F.col(top) <= F.col(below) * most + noise(most)
    return ok & (F.col(top) >= F.col(below) * least - noise(least)) if two_sided else ok


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row per row of docs: id, the counts, base_failed and kept.

    Null and empty texts have no words and fail the base rule; fences are learned from the texts that pass it. Null
    languages or sources form groups of their own. Texts on a fence stay. Rows that repeat an id are judged each by
    itself; an empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    groups = [f"g{i}" for i in range(len(group_cols))]
    counts = cut(quality_counts(docs, id_col, text_col, group_cols), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rates = _rates(counts.withColumn("base_failed", failed))
    known = cut(fences(cut(adaptive_sketches(rates.filter("not base_failed"), groups), "sketches"), groups), "fences")
    on = F.lit(True)
    for c in groups:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    joined = rates.alias("r").join(known.select(*groups, F.struct(*RATES).alias("fence")).alias("f"), on, "left")
    ok = F.lit(True)
    for r in RATES:
        ok = ok & within(r, *[F.get(F.col(f"fence.{r}"), i) for i in range(3)])
    kept = ~F.col("base_failed") & F.coalesce(ok, F.lit(True))
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
