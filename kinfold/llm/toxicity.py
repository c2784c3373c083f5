"""Toxicity by maximum-scoring segments.

Words score by their log-odds under an informative Dirichlet prior (the background frequencies), for whole words and
for word beginnings, each counted once a text; all other words share one small negative score. A linear-time scan, in
which every occurrence has its full score, finds every maximal-scoring segment of a text. An extreme-value law fitted on
all segments of clean texts turns segment scores into expected counts, the significant passages of a text are summed,
and a logistic curve gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded, cut, map_columns

#: The bound of the training sample: about so many labelled texts of each class, picked by a hash of the id.
TRAINING_ROWS = 20_000
#: Word beginnings of these lengths are terms as well.
BEGINNINGS = (4, 5, 6)
#: The prior's weight as a share of the words counted, and what a term needs to get a score of its own.
PRIOR_SHARE, LEAST_COUNT, LEAST_LOG_ODDS, LEAST_Z = 0.01, 5, 1.0, 4.0
#: A passage is significant if texts of its length are expected to hold fewer such by chance.
SIGNIFICANT = 0.05
CACHE = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The terms of a word: each run of letters, lower case, whole (=) and by its beginnings (^)."""
    out = []
    for part in LETTERS.findall(word.lower()):
        out.append("=" + part)
        out += ["^" + part[:n] for n in BEGINNINGS if len(part) > n]
    return out


def maximal_segments(at: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """(begin, end, score) of every maximal-scoring segment; scores stand at the positions, all others have the drift (< 0).

    Each candidate keeps a link to the last one that begins lower, so the search for it is linear over the whole scan.
    """
    segments: list[tuple[int, int, float, float]] = []
    links: list[int] = []
    total, upto = 0.0, 0
    for p, s in zip(at, scores, strict=True):
        low = total + drift * (p - upto)
        total, upto = low + s, p + 1
        begin = p
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= low:
                j = links[j]
            if j < 0 or segments[j][3] >= total:
                break
            begin, _, low, _ = segments[j]
            del segments[j:], links[j:]
        segments.append((begin, p + 1, low, total))
        links.append(j)
    return [(a, b, high - low) for a, b, low, high in segments]


class Model:
    """Term scores, the drift of other words, the extreme-value law (rate, scale) and the logistic curve (intercept, slope)."""

    def __init__(self, terms: dict[str, float], drift: float, toxic: int = 0, clean: int = 0):
        self.terms, self.drift = terms, drift
        prior = (toxic + 0.5) / (toxic + clean + 2)  # without any label 1 in 4
        self.rate, self.scale, self.intercept, self.slope = 1.0, 1.0, math.log(prior / (1 - prior)), 0.0

    def word_score(self, word: str) -> float:
        """The best of a word's terms, 0 for other words."""
        return max((self.terms.get(t, 0.0) for t in terms_of(word)), default=0.0)

    def surprise(self, score: float, words: int) -> float:
        """-log of how many segments of such a score clean texts of so many words hold."""
        return self.rate * score - math.log(self.scale * max(words, 1))

    def evidence(self, segments: list[tuple[int, int, float]], words: int) -> tuple[float, list[int]]:
        """The summed surprise of the significant segments, and which they are."""
        least = -math.log(SIGNIFICANT)
        found = [(k, v) for k, (_, _, s) in enumerate(segments) if (v := self.surprise(s, words)) >= least]
        return sum(v for _, v in found), [k for k, _ in found]

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * math.log1p(evidence)))))


class Scanner:
    """Segments of texts; keeps the scores of words seen in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of words, maximal segments by word position)."""
        words = text.split() if text else []
        if len(self.known) > CACHE:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = self.model.word_score(w)
        scores = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(scores)
        return len(words), maximal_segments(at.tolist(), scores[at].tolist(), self.model.drift)


def _terms(sample: DataFrame) -> tuple[dict[str, float], float]:
    """Term scores and the drift from the (label, text) rows of a sample."""

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for a, b in bounded(batch["text"]):
                terms = [Counter(), Counter()]
                for label, text in zip(batch["label"][a:b].to_pylist(), batch["text"][a:b].to_pylist(), strict=True):
                    own = {t for w in set(text.split() if text else []) for t in terms_of(w)}
                    terms[label].update(own)
                    terms[label]["*"] += sum(t[0] == "=" for t in own)
                names = list(terms[0] | terms[1])
                yield {"term": names, "n1": [terms[1][t] for t in names], "n0": [terms[0][t] for t in names]}

    counts = cut(map_columns(sample, count, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "terms")
    total = counts.filter("term = '*'").head()
    if total is None or not total["n1"] or not total["n0"]:
        return {}, -1.0
    n1, n0 = total["n1"], total["n0"]
    prior = PRIOR_SHARE * (n1 + n0)
    own = F.lit(PRIOR_SHARE) * (F.col("n1") + F.col("n0"))
    odds = F.log((F.col("n1") + own) / (n1 + prior - F.col("n1") - own)) - F.log((F.col("n0") + own) / (n0 + prior - F.col("n0") - own))
    z = odds / F.sqrt(1 / (F.col("n1") + own) + 1 / (F.col("n0") + own))
    best = (
        counts.filter(F.col("term") != "*")
        .filter(F.col("n1") + F.col("n0") >= LEAST_COUNT)
        .select("term", "n1", "n0", odds.alias("odds"), z.alias("z"))
        .filter((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("z") >= LEAST_Z))
        .collect()  # of the bounded sample's vocabulary the few that tell toxic texts
    )
    # What the scored words take from the toxic texts more than from the clean ones is missing from all others.
    m1, m0 = (min(0.5, sum(r[c] for r in best if r["term"][0] == "=") / n) for c, n in (("n1", n1), ("n0", n0)))
    return {r["term"]: r["odds"] for r in best}, min(-0.01, math.log((1 - m1) / (1 - m0)))


def _calibrate(model: Model, sample: DataFrame, prior: float) -> None:
    """Fits the extreme-value law on all segments of clean texts and the logistic curve on both; collects a row per sampled text."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        scanner = Scanner(shared.value)
        for batch in batches:
            for a, b in bounded(batch["text"]):
                got = [scanner.segments(t) for t in batch["text"][a:b].to_pylist()]
                yield {"label": batch["label"][a:b], "words": [n for n, _ in got], "scores": [[s for _, _, s in x] for _, x in got]}

    scanned = cut(map_columns(sample, scan, "label int, words long, scores array<double>"), "segments")
    clean = scanned.filter("label = 0")
    words = max(1, clean.agg(F.sum("words")).head()[0] or 0)
    chance = clean.select(F.explode("scores").alias("s"))
    middle = chance.agg(F.percentile("s", F.lit(0.5))).head()[0]
    if middle is not None:
        # The rate of an exponential tail over its median; the scale makes the expected count at the median right.
        n, excess = chance.filter(F.col("s") >= middle).agg(F.count("s"), F.avg(F.col("s") - middle)).head()
        model.rate = min(1.0, 1 / max(1e-9, excess or 0.0))
        model.scale = max(1, n) / words * math.exp(model.rate * middle)
    else:
        model.scale = 1 / words
    # As Model.evidence, without sending the segments to the driver.
    surprise = lambda s: model.rate * s - F.log(model.scale * F.greatest("words", F.lit(1)))
    evidence = F.aggregate("scores", F.lit(0.0), lambda v, s: v + F.when(surprise(s) >= -math.log(SIGNIFICANT), surprise(s)).otherwise(0.0))
    rows = scanned.select("label", evidence.alias("evidence")).collect()
    x = np.log1p([r["evidence"] for r in rows])
    y = np.array([float(r["label"]) for r in rows])
    if not len(rows) or y.min() == y.max():
        return
    # The sample may hold classes in other shares than the table; a weak ridge keeps separable classes finite.
    weight = np.where(y > 0, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hessian, design.T @ (weight * (y - p)) - 1e-2 * beta), -2, 2)
    model.intercept, model.slope = float(beta[0]), max(0.0, float(beta[1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", training_rows: int = TRAINING_ROWS) -> Model:
    """A model from the labels (0 or 1; null labels, ids and texts are left out) and the texts with the same ids.

    Three quarters of the sample give term scores, the rest the extreme-value law and the curve. If labels are missing
    or all alike, or no term tells the classes apart, every text gets the (smoothed) share of toxic labels as its score.
    Of several labels of one id the toxic one holds.
    """
    own = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, -1.0, n.get(1, 0), n.get(0, 0))
    share = F.when(F.col("label") == 1, min(1.0, training_rows / n[1])).otherwise(min(1.0, training_rows / n[0]))
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20))
    picked = own.filter(place < (1 << 20) * share).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(4)))
    # About 2 * training_rows ids, whatever the tables' size: a bounded broadcast.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sample = cut(texts.join(F.broadcast(picked), "id").select("part", "label", "text"), "toxicity")
    model = Model(*_terms(sample.filter("part > 0").select("label", "text")), n[1], n[0])
    if model.terms:
        _calibrate(model, sample.filter("part = 0").select("label", "text"), n[1] / (n[0] + n[1]))
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1) and passages, an array of (begin, end, score, expected).

    Passages are the significant segments, as code points of the text; expected is how many such a clean text of that
    length holds by chance. Null and empty texts have none and get the score of no evidence. Rows that repeat an id are
    scored each by itself; other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        scanner = Scanner(m)
        for batch in batches:
            for a, b in bounded(batch["text"]):
                scores, passages = [], []
                for text in batch["text"][a:b].to_pylist():
                    words, segments = scanner.segments(text)
                    evidence, which = m.evidence(segments, words)
                    scores.append(m.score(evidence))
                    found = []
                    if which:
                        spans = [w.span() for w in re.finditer(r"\S+", text)]
                        for k in which:
                            begin, end, s = segments[k]
                            found.append({"begin": spans[begin][0], "end": spans[end - 1][1], "score": s, "expected": math.exp(-m.surprise(s, words))})
                    passages.append(found)
                yield {"id": batch["id"][a:b], "score": scores, "passages": passages}

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    types = f"id {kind}, score double, passages array<struct<begin:int,end:int,score:double,expected:double>>"
    return map_columns(read, run, types).withColumnRenamed("id", id_col)
