"""Token ids of a byte-level BPE, as the tokenizers library gives them, at the cost of a few array operations a word.

Texts are cut, all together, where their pre-tokens always break: before a single space between characters of which one
is no white space, around a line feed between others, and between a letter and a mark. Of each portion of texts every
distinct chunk is encoded by the library once; a bounded cache keeps it. Texts with characters outside a plain range,
with special tokens in them or with awkward white space go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from kinfold.llm.common import held

# A task has the cores that Spark gives it: the library's own threads would take those of others and spin between texts.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WHITE = re.compile(r"\s")
#: Words kept, at about 200 bytes each; as many again stay until they are wanted or the next ones are put aside.
CACHE = 150_000
#: Words that the library encodes as one text.
TOGETHER = 256
LONGEST_CACHED = 64


def _bytes_in(*parts: range) -> np.ndarray:
    """A table of 256 truth values: whether a byte is in one of the ranges."""
    table = np.zeros(256, bool)
    for part in parts:
        table[list(part)] = True
    return table


#: Bytes of no plain text: of the characters to U+024F controls are none, and longer ones begin with 0xCA or more.
ODD = _bytes_in(range(0x09), range(0x0B, 0x0D), range(0x0E, 0x20), range(0x7F, 0x80), range(0xCA, 0x100))
BLANK = _bytes_in(range(0x09, 0x0B), range(0x0D, 0x0E), range(0x20, 0x21))
LETTER = _bytes_in(range(0x41, 0x5B), range(0x61, 0x7B))
MARK = _bytes_in(range(0x21, 0x30), range(0x3A, 0x41), range(0x5B, 0x61), range(0x7B, 0x7F))


class Bytes:
    """The UTF-8 bytes of texts one after the other, and what stands beside a byte; borders of texts count as no white space."""

    def __init__(self, texts: pa.StringArray):
        first, data = texts.buffers()[1:]
        self.offsets = np.frombuffer(first, np.int32, len(texts) + 1, 4 * texts.offset)
        begin, end = int(self.offsets[0]), int(self.offsets[-1])
        self.buffer = data.slice(begin, end - begin) if end > begin else pa.py_buffer(b"")
        self.offsets = self.offsets - begin
        self.size = end - begin
        self._padded = np.zeros(self.size + 4, np.uint8)
        self.data = self._padded[2 : self.size + 2]
        self.data[:] = np.frombuffer(self.buffer, np.uint8)

    def beside(self, at: np.ndarray, by: int) -> np.ndarray:
        return self._padded[at + (2 + by)]

    def blank_before(self, at: np.ndarray) -> np.ndarray:
        last = self.beside(at, -1)
        return BLANK[last] | ((last == 0xA0) & (self.beside(at, -2) == 0xC2))

    def blank_after(self, at: np.ndarray) -> np.ndarray:
        following = self.beside(at, 1)
        return BLANK[following] | ((following == 0xC2) & (self.beside(at, 2) == 0xA0))

    def odd(self) -> np.ndarray:
        """Places of bytes that are in no plain text, and of spaces between white space (of two texts too: their library call is just slower)."""
        c2, c9, spaces = (np.flatnonzero(self.data == x) for x in (0xC2, 0xC9, 0x20))
        awkward = spaces[self.blank_before(spaces) & self.blank_after(spaces)]
        return np.concatenate([np.flatnonzero(ODD[self.data]), c2[self.beside(c2, 1) < 0xA0], c9[self.beside(c9, 1) > 0x8F], awkward])

    def chunks(self) -> np.ndarray:
        """Where the chunks of plain texts begin."""
        marks, feeds = np.flatnonzero(MARK[self.data]), np.flatnonzero(self.data == 0x0A)
        last, lead = self.beside(marks, -1), self.beside(marks, -2)
        # Of the letters' two-byte characters, U+00C0 to U+024F, only the signs of times and division are none.
        letter = LETTER[last] | ((last >= 0x80) & (lead >= 0xC3) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))))
        feeds = feeds[~(self.blank_before(feeds) | self.blank_after(feeds))]
        begins = self.data == 0x20
        begins[marks[letter]] = True
        begins[feeds] = True
        begins[feeds[feeds + 1 < self.size] + 1] = True
        begins[self.offsets[self.offsets < self.size]] = True
        return np.flatnonzero(begins)


def specials_of(tokenizer: Tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def tokenizer_file(name: str) -> str:
    """The path of a public vocabulary file on this machine, or the name itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """ids() and counts() of texts; one for a worker process and file (see byte_bpe)."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = specials_of(self.tokenizer)
        self.most = cache
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Ids whose token begins with a space.
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.feed = self._whole(["\n"])[0]
        #: The ids of chunks, and what was put aside.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.joinable = len(self.feed) == 4 and not any(" " in s for s in self.specials)

    def _pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _each(self, words: list[str], spaced: bool) -> dict[str, bytes]:
        """The ids of each word; spaced: all begin with a space and have no other one.

        Words without other white space are encoded many together, as they are or as lines. Spaces are found again by
        the tokens that begin with one, line feeds by their own token.
        """
        groups = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)] if self.joinable else []
        bare = (lambda w: w[1:]) if spaced else (lambda w: w)
        texts, joined = [], []
        for g in groups:
            text = "".join(g) if spaced else "\n" + "\n".join(g)
            if (" " in g or WHITE.search(text.replace(" ", ""))) if spaced else WHITE.search("".join(g)):
                g = [w for w in g if bare(w) and not WHITE.search(bare(w))]
                text = "".join(g) if spaced else "\n" + "\n".join(g)
            if g:
                texts.append(text)
                joined.append(g)
        found: dict[str, bytes] = {}
        for group, encoded in zip(joined, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(encoded.ids, np.dtype("<u4"))
            borders = (4 * np.flatnonzero(self.begins[ids] if spaced else ids == int.from_bytes(self.feed, "little"))).tolist()
            skip = 0 if spaced else 4
            if len(borders) == len(group):
                packed = ids.tobytes()
                found.update((w, packed[a + skip : b]) for w, a, b in zip(group, borders, [*borders[1:], len(packed)], strict=True))
        rest = [w for w in words if w not in found] if len(found) < len(words) else []
        found.update(zip(rest, self._whole(rest), strict=True))
        return found

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of all the words, which differ; those of ordinary length are kept."""
        if len(self.kept) > self.most:
            self.older, self.kept = self.kept, {}
        out = list(map(self.kept.get, words))
        new = [w for w, ids in zip(words, out, strict=True) if ids is None]
        back = list(map(self.older.get, new))
        missing = [w for w, ids in zip(new, back, strict=True) if ids is None] if self.older else new
        found = {w: ids for w, ids in zip(new, back, strict=True) if ids is not None} if self.older else {}
        found |= self._each([w for w in missing if w[0] == " "], True)
        found |= self._each([w for w in missing if w[0] != " "], False)
        self.kept.update({w: ids for w, ids in found.items() if len(w) <= LONGEST_CACHED} if max(map(len, new), default=0) > LONGEST_CACHED else found)
        return [found[w] if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, texts: pa.StringArray) -> np.ndarray:
        """Whether each text can be cut into chunks."""
        held = Bytes(texts)
        out = np.ones(len(texts), bool)
        out[np.searchsorted(held.offsets, held.odd(), side="right") - 1] = False
        for special in self.specials:
            out &= ~pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        return out

    def _chunked(self, texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of plain texts: the ids of the distinct chunks, which of them each chunk is, and each text's first chunk, with the end."""
        held = Bytes(texts)
        begins = held.chunks()
        borders = pa.py_buffer(np.append(begins, held.size).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(begins), borders, held.buffer).dictionary_encode()
        return self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy(), np.searchsorted(begins, held.offsets)

    def _split(self, texts: Sequence[str | None] | pa.StringArray) -> tuple[pa.StringArray, np.ndarray, list[bytes]]:
        """The plain texts, which ones these are, and the ids of all others. A null is an empty text."""
        every = pc.fill_null(texts if isinstance(texts, pa.StringArray) else pa.array(texts, pa.string()), "")
        plain = self.plain(every)
        return every.filter(pa.array(plain)), plain, self._whole(every.filter(pa.array(~plain)).to_pylist())

    def packed(self, texts: Sequence[str | None] | pa.StringArray) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        chosen, plain, others = self._split(texts)
        known, which, firsts = self._chunked(chosen)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        each = sizes[which]
        ends = np.append(0, np.cumsum(each))
        # The ids of chunk after chunk, each taken from where its distinct chunk begins.
        ids = np.frombuffer(b"".join(known), "<u4")[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], each) + np.arange(ends[-1])].tobytes()
        borders = (4 * ends[firsts]).tolist()
        cut, rest = (ids[a:b] for a, b in zip(borders, borders[1:], strict=False)), iter(others)
        return [next(cut if p else rest) for p in plain.tolist()]

    def counts(self, texts: Sequence[str | None] | pa.StringArray) -> list[int]:
        chosen, plain, others = self._split(texts)
        known, which, firsts = self._chunked(chosen)
        ends = np.append(0, np.cumsum(np.fromiter(map(len, known), np.int64, len(known))[which]))[firsts] // 4
        out = np.zeros(len(plain), np.int64)
        out[plain], out[~plain] = np.diff(ends), [len(ids) // 4 for ids in others]
        return out.tolist()


def byte_bpe(name: str) -> ByteBpe:
    """The encoder of this worker process for a file."""
    return held(("byte_bpe", name), lambda: ByteBpe(tokenizer_file(name)))
