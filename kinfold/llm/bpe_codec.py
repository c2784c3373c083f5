"""BPE encoding and decoding with word ends by tree concatenation.

Every text longer than a leaf is cut at any character into leaves, which are encoded side by side; halves are then
joined upwards like a tree. At each join a window around the border is encoded anew and grows until its first part is
the left side's own and its last part the right side's own, so that the result is exactly that of encoding the whole.

Two trees do so. Over a text, the parts are pre-tokens, which follow from their place alone once both sides agree on
one (in texts of uncommon characters, the words between ASCII white space); a bounded cache keeps their ids. A single run without any border for the pre-tokenizer (a word of thousands of letters)
has a tree of its own, whose parts are tokens: neighbouring tokens of an encoding decide alone whether it stands.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from kinfold.llm.common import bounded, ddl, held, map_columns
from kinfold.llm.tokens import CACHE, LONGEST_CACHED, TOGETHER, specials_of, tokenizer_file

TOKENIZER = "word_bpe_49k.json"
#: Runs of more bytes than this are encoded as trees with leaves of so many bytes.
LONG, LEAF = 2048, 512
#: Texts of more characters than this are encoded as trees with leaves of so many characters.
TEXT_LEAF = 1024
ASCII_WORDS = re.compile(r"[^\x20\x09-\x0d]+")
#: Characters of which lower case, composition and classes don't differ between libraries.
PLAIN = re.compile("[^\x09\x0a\x0d\x20-\x7e\xa0-įı-ɏ]")
#: The pre-tokens of a lower-case text of such characters, and a part that is letters or one digit.
PLAIN_LETTERS, PLAIN_DIGITS = ("".join(re.escape(chr(c)) for c in range(0x21, 0x250) if chr(c).isprintable() and regex.fullmatch(p, chr(c))) for p in (r"\p{L}", r"\p{N}"))
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{PLAIN_LETTERS}]+|[{PLAIN_DIGITS}]|[^{PLAIN_LETTERS}{PLAIN_DIGITS}\x09\x0a\x0d\x20\xa0]+")
ONE_RUN = re.compile(f"[{PLAIN_LETTERS}]+|[{PLAIN_DIGITS}]")


class TreeBpe:
    """Encodes one unsplit run of byte-level symbols as (ids, number of symbols of each)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        kind = {"continuing_subword_prefix": model.get("continuing_subword_prefix") or None}
        # A run whose last symbol does not end the word must not get the word-end mark.
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **{k: v for k, v in kind.items() if v}))
        self.last = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.end, **{k: v for k, v in kind.items() if v})) if self.end else self.inner

    def _leaves(self, parts: list[str], last: bool) -> list[list[tuple[int, int]]]:
        """Tokens (id, symbols) of each part; the library works on them in parallel."""
        inner = self.inner.encode_batch(parts[:-1] if last else parts, add_special_tokens=False)
        done = inner + (self.last.encode_batch(parts[-1:], add_special_tokens=False) if last else [])
        return [[(i, b - a) for i, (a, b) in zip(e.ids, e.offsets, strict=True)] for e in done]

    def _join(self, text: str, at: int, left: list[tuple[int, int]], right: list[tuple[int, int]], ends: bool) -> list[tuple[int, int]]:
        """Joins the tokens left and right of text[at]; ends: the right side ends the word."""
        k = 1
        while True:
            before, after = left[-k:], right[:k]
            a, b = at - sum(n for _, n in before), at + sum(n for _, n in after)
            all_left, all_right = k >= len(left), k >= len(right)
            window = self._leaves([text[a:b]], ends and all_right)[0]
            if (all_left or window[0] == before[0]) and (all_right or window[-1] == after[-1]):
                return left[: len(left) - len(before)] + window + right[len(after) :]
            k *= 2

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        borders = [*range(0, len(text), leaf), len(text)]
        parts = [text[a:b] for a, b in zip(borders, borders[1:], strict=False)]
        level = self._leaves(parts, True)
        while len(level) > 1:
            joined, kept = [], borders[::2] + ([borders[-1]] if len(borders) % 2 == 0 else [])
            for i in range(0, len(level), 2):
                if i + 1 == len(level):
                    joined.append(level[i])
                else:
                    joined.append(self._join(text, borders[i + 1], level[i], level[i + 1], i + 2 == len(level)))
            level, borders = joined, kept
        return [i for i, _ in level[0]] if level else []


class WordBpe:
    """Ids and decoded text as the library's encode and decode give them.

    A text is cut into leaves at any character. The parts of all leaves are encoded side by side, each new one by the
    library; then pairs of neighbours are joined, level by level, by encoding a window of parts around the border anew.
    """

    def __init__(self, path: str, cache: int = CACHE, leaf: int = TEXT_LEAF):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        self.specials = specials_of(self.tokenizer)
        self.tree = TreeBpe(spec)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [self.tokenizer.id_to_token(i) for i in range(size)]
        #: Ids whose token ends a pre-token.
        self.ends = np.array([bool(self.tree.end) and (t or "").endswith(self.tree.end) for t in self.pieces])
        self.most, self.leaf, self.joins = cache, leaf, 0
        #: Of each part its ids as little-endian 32-bit integers; `older` holds those that may go next.
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _long_runs(self, text: str) -> bool:
        return len(text) > LONG and any(len(w.encode()) > LONG for w in self.pattern.findall(text))

    def _tree(self, text: str) -> list[int]:
        """A text with long runs: its special tokens cut out, then each run by itself."""
        ids: list[int] = []
        for part in regex.split("(" + "|".join(map(regex.escape, self.specials)) + ")", text) if self.specials else [text]:
            if part in self.specials:
                ids.append(self.tokenizer.token_to_id(part))
                continue
            for run, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                ids += self.tree.encode(run)
        return ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        long = {i for i, t in enumerate(texts) if self._long_runs(t)}
        rest = iter(self.tokenizer.encode_batch_fast([t for i, t in enumerate(texts) if i not in long], add_special_tokens=False))
        ids = [self._tree(t) if i in long else next(rest).ids for i, t in enumerate(texts)]
        return [struct.pack(f"<{len(x)}i", *x) for x in ids]

    def _together(self, parts: list[str]) -> dict[str, bytes]:
        """Pre-tokens encoded many in one text, and told apart by the tokens that end them."""
        groups = [parts[a : a + TOGETHER] for a in range(0, len(parts), TOGETHER)]
        found: dict[str, bytes] = {}
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, "<i4")
            borders = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(borders) == len(group):
                packed = ids.tobytes()
                found.update((w, packed[a:b]) for w, a, b in zip(group, [0, *borders], borders, strict=False))
        return found

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): without a decoder of its own the library joins tokens by spaces."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join([t for i in ids if 0 <= i < len(self.pieces) and (t := self.pieces[i]) is not None])

    def _learn(self, parts: set[str]) -> None:
        """Sees to it that the ids of all parts are known."""
        new = []
        for w in parts.difference(self.packed):
            if (ids := self.older.get(w)) is not None:
                self.packed[w] = ids
            else:
                new.append(w)
        plain = [w for w in new if len(w) <= LONGEST_CACHED and ONE_RUN.fullmatch(w)]
        self.packed.update(self._together(plain))
        rest = [w for w in new if w not in self.packed]
        self.packed.update(zip(rest, self._whole(rest), strict=True))

    def _forget(self) -> None:
        """After a slice: what it used stays for the next ones, what it did not use goes."""
        if len(self.packed) > self.most:
            self.older = {w: ids for w, ids in self.packed.items() if len(w) <= LONGEST_CACHED}
            self.packed = {}

    def parts(self, texts: list[str]) -> list[list[str]]:
        """Each text as parts whose encodings follow one another in that of the text; all of them are learned."""
        plain = [not PLAIN.search(t) and not any(s in t for s in self.specials) for t in texts]
        texts = [t.lower() if p else t for t, p in zip(texts, plain, strict=True)]
        split = [PRE_TOKENS.findall if p else ASCII_WORDS.findall for p in plain]
        trees = [[(a, min(a + self.leaf, len(t)), cut_up(t[a : a + self.leaf])) for a in range(0, len(t), self.leaf)] for t, cut_up in zip(texts, split, strict=True)]
        self._learn({part for level in trees for _, _, own in level for part in own})
        growing = [i for i, level in enumerate(trees) if len(level) > 1]
        while growing:
            level = [(i, j, 1) for i in growing for j in range(0, len(trees[i]) - 1, 2)]
            done: dict[int, list] = {i: [] for i in growing}
            self.joins += len(level)
            while level:
                windows = [self._window(texts[i], trees[i][j], trees[i][j + 1], k, split[i]) for i, j, k in level]
                self._learn({part for window in windows for part in window})
                wider = []
                for (i, j, k), window in zip(level, windows, strict=True):
                    (begin, _, left), (_, end, right) = trees[i][j : j + 2]
                    if window and not (self._agrees(left, k, -k, window[0]) and self._agrees(right, k, k - 1, window[-1])):
                        wider.append((i, j, 2 * k))
                    else:
                        done[i].append((begin, end, left[: max(0, len(left) - k)] + window + right[k:]))
                level = wider
            for i in growing:
                trees[i] = sorted(done[i] + trees[i][len(trees[i]) // 2 * 2 :], key=lambda part: part[0])
            growing = [i for i in growing if len(trees[i]) > 1]
        return [level[0][2] if level else [] for level in trees]

    def _agrees(self, side: list[str], k: int, at: int, outer: str) -> bool:
        """Whether the window's outer part is what that side has there; a side that is used up has no say."""
        return k >= len(side) or (side[at] == outer and self.packed[side[at]] == self.packed[outer])

    def _window(self, text: str, left: tuple, right: tuple, k: int, cut_up: Callable) -> list[str]:
        """The last k parts on the left and the first k on the right, cut up as one text."""
        (begin, a, before), (b, end, after) = left, right
        for part in before[: -k - 1 : -1]:
            a = text.rfind(part, begin, a)
        for part in after[:k]:
            b = text.find(part, b, end) + len(part)
        return cut_up(text[a:b])

    def encode_packed(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """(packed ids, decoded text) of each text."""
        ids = [b"".join(map(self.packed.__getitem__, own)) for own in self.parts(texts)]
        self._forget()
        if self.tokenizer.decoder is not None:
            return ids, [self.decode(np.frombuffer(x, "<i4").tolist()) for x in ids]
        return ids, [" ".join(map(self.pieces.__getitem__, np.frombuffer(x, "<i4").tolist())) for x in ids]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """(ids, decoded text) of each text."""
        return [(np.frombuffer(ids, "<i4").tolist(), decoded) for ids, decoded in zip(*self.encode_packed(texts), strict=True)]


def word_bpe(name: str) -> WordBpe:
    return held(("word_bpe", name), lambda: WordBpe(tokenizer_file(name)))


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per row of docs: id, ids (array<int>) and decoded.

    Null and empty texts have no ids and decode to "". Rows that repeat an id are encoded each by itself; an empty table
    gives none; other columns of docs, whatever their names, are not read. Memory follows one slice of texts (2 MB, or
    one text).
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            for a, b in bounded(batch["text"]):
                ids, decoded = bpe.encode_packed([t or "" for t in batch["text"][a:b].to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]) // 4
                values = np.frombuffer(b"".join(ids), "<i4")
                yield {"id": batch["id"][a:b], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)), "decoded": decoded}

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_columns(read, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """encoded with a column `decoded` (a column of that name is replaced), for ids made elsewhere.

    Null ids decode to null, no ids to "", and ids that the vocabulary lacks to nothing. Repeated rows are decoded each
    by itself, and an empty table stays empty.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            yield {**batch, "decoded": [None if x is None else bpe.decode([i for i in x if i is not None]) for x in batch[ids_col].to_pylist()]}

    return map_columns(encoded, run, ddl(f for f in encoded.schema if f.name.lower() != "decoded") + ", decoded string")
