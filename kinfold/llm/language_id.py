"""Language ID by unigram pieces with the segmentation summed out.

Every language has a probability for each piece of a fixed public vocabulary. A text's score under a language is the
product over its words of the total probability of all ways to cut the word into pieces, which a forward algorithm
sums. The probabilities are fitted by expectation maximisation (forward-backward) over word counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import WHITE_CLASS, bounded, cut, ddl, held, map_columns
from kinfold.llm.tokens import tokenizer_file

VOCABULARY = "piece_bpe_32k.model"
#: The bound of the training sample: about so many texts of each language, picked by a hash of the id.
TRAINING_ROWS = 3000
ROUNDS = 2
#: Share of a language's probability that goes evenly to all pieces.
SMOOTHING = 1e-3
#: Words of more characters are scored one by one with rescaled sums, and give their counts to the fit in parts of so many.
LONGEST_WORD = 48
#: Words kept by a task, at about 200 bytes and 8 bytes a language each; as many again stay until they are wanted.
CACHE = 80_000
#: Characters times languages that are looked at together.
PORTION = 200_000
UNDETERMINED = "und"


def vocabulary(name: str = VOCABULARY) -> dict[str, int]:
    """Lower-case pieces in the vocabulary's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
    pieces: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.setdefault(piece, len(pieces))
    return pieces


class Trie:
    """The pieces as a tree of characters in a hash table of arrays, so that all places of many words are looked up at once."""

    def __init__(self, pieces: dict[str, int]):
        alphabet = {c: k for k, c in enumerate(sorted(set("".join(pieces))), 1)}
        self.width, self.unknown, self.longest = len(alphabet) + 1, len(pieces), max(map(len, pieces), default=1)
        self.codes = np.zeros(0x110000, np.int32)  # 0: a character of no piece
        for c, k in alphabet.items():
            self.codes[ord(c)] = k
        nodes: dict[int, int] = {}  # parent * width + character: child; the root is 0
        piece_of = [-1]
        for piece, i in pieces.items():
            node = 0
            for c in piece:
                node = nodes.setdefault(node * self.width + alphabet[c], len(piece_of))
                if node == len(piece_of):
                    piece_of.append(-1)
            piece_of[node] = i
        self.piece_of = np.array(piece_of, np.int64)
        self.bits = max(4, (4 * len(nodes)).bit_length())
        self.keys, self.children = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
        first = self._slots(np.fromiter(nodes, np.int64, len(nodes))).tolist()
        for (key, child), at in zip(nodes.items(), first, strict=True):
            while self.children[at]:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.children[at] = key, child

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by each character; 0 if there is none."""
        keys = nodes * self.width + codes
        at = self._slots(keys)
        out = self.children[at]
        away = np.flatnonzero((self.keys[at] != keys) & (out > 0))
        while len(away):
            at[away] = (at[away] + 1) & ((1 << self.bits) - 1)
            out[away] = self.children[at[away]]
            away = away[(self.keys[at[away]] != keys[away]) & (out[away] > 0)]
        return out


class Lattice:
    """All segmentations of many words: edges from a place to a later one by a piece, ordered by the first place in its word."""

    def __init__(self, words: list[str], trie: Trie):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = trie.codes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        within = np.arange(len(codes)) - (ends - sizes)[word]
        left = sizes[word] - within  # characters from here to the end of the word
        self.begin, self.end = ends - sizes + np.arange(len(words)), ends + np.arange(len(words))
        self.places = len(codes) + len(words)
        alive, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        for d in range(trie.longest):
            node = trie.step(node, codes[alive + d])
            ids = trie.piece_of[node]
            if d == 0:
                ids[ids < 0] = trie.unknown
            some = np.flatnonzero(ids >= 0)
            found.append((alive[some], np.full(len(some), d, np.int64), ids[some]))
            go = np.flatnonzero((node > 0) & (left[alive] > d + 1))
            alive, node = alive[go], node[go]
            if not len(alive):
                break
        at, d, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        rank = within[at] * trie.longest + d
        order = np.argsort(rank.astype(np.uint16) if len(rank) and rank.max() < 1 << 16 else rank, kind="stable")
        at, rank = at[order], rank[order]
        self.word = word[at]
        self.source = at + self.word
        self.target = self.source + d[order] + 1
        self.ids = ids[order]
        firsts = np.flatnonzero(np.diff(rank, prepend=-1))
        #: Edges with the same places in their words; no two of one slice touch the same place.
        self.slices = list(zip(firsts.tolist(), [*firsts[1:].tolist(), len(rank)], strict=True)) if len(rank) else []

    def alpha(self, chance: np.ndarray) -> np.ndarray:
        """Total chance of all ways to each place; chance: [edge, language]."""
        out = np.zeros((self.places, chance.shape[1]))
        out[self.begin] = 1
        for a, b in self.slices:
            out[self.target[a:b]] += out[self.source[a:b]] * chance[a:b]
        return out

    def beta(self, chance: np.ndarray) -> np.ndarray:
        """Total chance of all ways from each place to the end of its word."""
        out = np.zeros((self.places, chance.shape[1]))
        out[self.end] = 1
        for a, b in reversed(self.slices):
            out[self.source[a:b]] += out[self.target[a:b]] * chance[a:b]
        return out


def forward(words: list[str], pieces: dict[str, int], table: np.ndarray, trie: Trie | None = None) -> np.ndarray:
    """log of the sum over all segmentations, [word, language]; table: [piece, language], last row 0."""
    paths = Lattice(words, trie or Trie(pieces))
    return np.log(np.maximum(paths.alpha(table[paths.ids])[paths.end], 1e-300))


def expected(words: list[str], weights: np.ndarray, pieces: dict[str, int], table: np.ndarray, trie: Trie | None = None) -> np.ndarray:
    """Expected uses of each piece by language, [piece, language]; weights: [word, language] counts."""
    paths = Lattice(words, trie or Trie(pieces))
    chance = table[paths.ids]
    alpha, beta = paths.alpha(chance), paths.beta(chance)
    scale = weights / np.maximum(alpha[paths.end], 1e-300)
    uses = alpha[paths.source] * chance * beta[paths.target] * scale[paths.word]
    out = np.stack([np.bincount(paths.ids, uses[:, k], len(table)) for k in range(table.shape[1])], axis=1)
    out[-1] = 0
    return out


def long_forward(word: str, table: np.ndarray, trie: Trie) -> np.ndarray:
    """As forward, of one word of any length: the sums of the last places, scaled up again as they get small."""
    width, languages = trie.longest, table.shape[1]
    codes = trie.codes[np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sums, logs = np.zeros((width + 1, languages)), np.zeros(languages)
    sums[0] = 1
    for begin in range(0, len(codes), 4096):
        here = codes[begin : begin + 4096 + width - 1]
        alive, node = np.arange(min(4096, len(codes) - begin)), np.zeros(min(4096, len(codes) - begin), np.int64)
        edges: list[list[tuple[int, int]]] = [[] for _ in alive]
        for d in range(width):
            node = trie.step(node, here[alive + d])
            ids = trie.piece_of[node]
            if d == 0:
                ids[ids < 0] = trie.unknown
            for i, k in zip(alive[ids >= 0].tolist(), ids[ids >= 0].tolist(), strict=True):
                edges[i].append((d + 1, k))
            go = np.flatnonzero((node > 0) & (alive + d + 1 < len(here)))
            alive, node = alive[go], node[go]
            if not len(alive):
                break
        for i, own in enumerate(edges, begin):
            place = i % (width + 1)
            for d, k in own:
                sums[(place + d) % (width + 1)] += sums[place] * table[k]
            sums[place] = 0
            if i % 8 == 7:
                most = np.maximum(sums.max(axis=0), 1e-300)
                sums /= most
                logs += np.log(most)
    return logs + np.log(np.maximum(sums[len(codes) % (width + 1)], 1e-300))


def trie_of(name: str) -> Trie:
    """The tree of a vocabulary, held by a worker process."""
    return held(("trie", name), lambda: Trie(vocabulary(name)))


def portions(words: list[str], languages: int) -> Iterator[slice]:
    """Slices of words, each with a bounded number of characters times languages."""
    begin, total = 0, 0
    for i, w in enumerate(words):
        total += (len(w) + 1) * languages
        if total > PORTION:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(words):
        yield slice(begin, len(words))


#: Marks at the ends of words say nothing of the language.
PUNCTUATION = ".,;:!?\"'()[]{}|$#*<>%&-"


def marked(word: str) -> str:
    """The word as the vocabulary spells it: lower case, no marks at its ends, its begin marked."""
    return "▁" + (word.strip(PUNCTUATION) or word).lower()


class Model:
    """Languages and log-free piece probabilities, [piece + unknown + 0-row, language]; its size is that of the vocabulary times the languages."""

    def __init__(self, languages: list[str], table: np.ndarray, prior: np.ndarray, name: str):
        self.languages, self.table, self.prior, self.name = languages, table, prior, name


def normalised(counts: np.ndarray) -> np.ndarray:
    """Counts [piece + unknown + 0-row, language] to probabilities; the last row stays 0."""
    p = np.zeros_like(counts)
    total = np.maximum(counts[:-1].sum(axis=0), 1e-9)
    p[:-1] = (1 - SMOOTHING) * counts[:-1] / total + SMOOTHING / (len(counts) - 1)
    return p


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, name: str = VOCABULARY, training_rows: int = TRAINING_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of all the languages of labelled rows (null languages and texts are left out; no rows give no languages).

    The driver holds a probability for each piece and language, 256 KB a language, and the counts of each round.
    Repeated rows count as often as they come, as far as the sample by a hash of the id takes them; languages that are
    equally frequent go by their names.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages, pieces = sorted(r["lang"] for r in seen), vocabulary(name)
    size = (len(pieces) + 2, len(languages))
    total = sum(r["n"] for r in seen)
    prior = np.array([dict(seen)[x] / total for x in languages]) if languages else np.zeros(0)
    if not languages:
        return Model([], np.zeros(size), prior, name)
    # A share of each language's rows by a hash of the id: about training_rows, whatever the table's size.
    share = F.create_map(*[F.lit(x) for r in seen for x in (r["lang"], min(1.0, training_rows / r["n"]))])
    picked = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 20)) < (1 << 20) * share[F.col(lang_col)])
    each = F.array(*[F.count(F.when(F.col("lang") == F.lit(x), 1)).cast("double") for x in languages])
    words = cut(
        picked.select(F.col(lang_col).alias("lang"), F.explode(F.split(F.lower(F.col(text_col)), WHITE_CLASS + "+")).alias("word"))
        .filter("word <> ''")
        .groupBy("word")
        .agg(each.alias("n")),
        "words",
    )
    table = np.zeros(size)
    table[:-1] = 1 / (size[0] - 1)
    for p, i in pieces.items():  # longer pieces are as likely as their characters together would be
        table[i] = 30.0 ** -max(1, len(p))
    table[len(pieces)] = 1e-7
    for _ in range(rounds):
        shared = labelled.sparkSession.sparkContext.broadcast(table)

        def count(batches: Iterator[dict], shared=shared) -> Iterator[dict]:
            own, sums = trie_of(name), np.zeros(size)
            for batch in batches:
                n = np.array(batch["n"].to_pylist())
                spelt = map(marked, batch["word"].to_pylist())
                parts = [(w[a : a + LONGEST_WORD], k) for k, w in enumerate(spelt) for a in range(0, len(w), LONGEST_WORD)]
                texts, of = [p for p, _ in parts], np.array([k for _, k in parts])
                for part in portions(texts, len(languages)):
                    sums += expected(texts[part], n[of[part]], {}, shared.value, own)
            piece, lang = np.nonzero(sums)
            yield {"piece": piece, "lang": lang, "n": sums[piece, lang]}

        counts = map_columns(words, count, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got, found = np.zeros(size), counts.toArrow()  # at most pieces times languages
        got[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        table = normalised(got)
    return Model(languages, table, prior, name)


class Judge:
    """Languages of texts under a model; keeps the scores of words seen in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.trie = model, trie_of(model.name)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.languages)))
        self.older, self.older_scores = self.known, self.scores[:0]

    def _learn(self, split: list[list[str]]) -> None:
        if len(self.known) > CACHE:
            self.older, self.older_scores = self.known, self.scores
            self.known, self.scores = {}, np.zeros_like(self.scores)
        missing: set[str] = set()
        for words in split:
            missing.update(words)
        missing.difference_update(self.known)
        back = [w for w in missing if w in self.older]
        self._keep(back, self.older_scores[[self.older[w] for w in back]])
        new = list(missing.difference(back))
        of = list(map(marked, new))
        names = list(set(of))  # words that differ in case or end marks alone are scored once
        short, long = [w for w in names if len(w) <= LONGEST_WORD], [w for w in names if len(w) > LONGEST_WORD]
        logs = np.zeros((len(names), len(self.model.languages)))
        for part in portions(short, len(self.model.languages)):
            logs[part] = forward(short[part], {}, self.model.table, self.trie)
        for k, w in enumerate(long, len(short)):
            logs[k] = long_forward(w, self.model.table, self.trie)
        at = {w: i for i, w in enumerate(short + long)}
        self._keep(new, logs[[at[w] for w in of]])

    def _keep(self, words: list[str], scores: np.ndarray) -> None:
        n = len(self.known)
        if not words:
            return
        if n + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores[:n], np.zeros((n + 2 * len(words), len(self.model.languages)))])
        self.scores[n : n + len(words)] = scores
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of each text."""
        m = self.model
        split = [t.split() if t else [] for t in texts]
        self._learn(split)
        langs, sure = [], []
        for t, words in zip(texts, split, strict=True):
            if not m.languages or not t or not any(map(str.isalpha, t)):
                langs.append(UNDETERMINED)
                sure.append(0.0)
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            total = self.scores[at].sum(axis=0)
            z = total * min(1.0, 8 / max(1, len(words))) + np.log(m.prior)
            best = int(np.argmax(total + np.log(m.prior)))
            e = np.exp(z - z.max())
            langs.append(m.languages[best])
            sure.append(float(e[best] / e.sum()))
        return langs, sure


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (0 to 1, the posterior of that language at a damped word count).

    Texts that are null or have no letter are `und` with score 0, as are all texts if no language was learned. Ties go
    to the first language in order. Rows that repeat an id are judged each by itself; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        judge = Judge(shared.value)
        for batch in batches:
            for a, b in bounded(batch["text"]):
                langs, sure = judge.judge(batch["text"][a:b].to_pylist())
                yield {"id": batch["id"][a:b], "lang_pred": langs, "score": sure}

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_columns(read, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_determined(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """The rows of docs, all columns as they are, whose language is determined with at least that score.

    Every row is judged by itself, so repeated rows and null ids need no special care. Null texts and texts without a
    letter are undetermined and go; equally likely languages share the score. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        judge = Judge(shared.value)
        for batch in batches:
            for a, b in bounded(batch[text_col]):
                langs, sure = judge.judge(batch[text_col][a:b].to_pylist())
                stay = pa.array([x != UNDETERMINED and s >= least_score for x, s in zip(langs, sure, strict=True)])
                yield {n: v[a:b].filter(stay) for n, v in batch.items()}

    return map_columns(docs, run, ddl(docs.schema))
