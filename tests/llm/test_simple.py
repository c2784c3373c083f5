"""Exact dedup, quality rules, secret scans, packing, language ID, codec and rollups against plain versions."""

import functools
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import bpe_codec, exact_dedup, language_id, packing, quality_rules, queries, secret_scan, token_rollup, tokens
from kinfold.llm.common import scratch_path
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return by


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_dedup(spark, edge, docs, texts, none, counters):
    got = exact_dedup.exact_dedup(docs, counters=counters).collect()
    by = plain_groups(texts.items())
    want = {i: (min(ids), len(ids), i == min(ids), sha(t)) for t, ids in by.items() for i in ids}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want
    assert len(got) == len(texts)
    got = exact_dedup.exact_dedup(edge, counters=counters).collect()
    assert len(got) == len(EDGE)
    same = [r for r in got if r["keep_id"] == 5]
    assert Counter((r["doc_id"], r["kept"]) for r in same) == Counter([(5, True), (6, False), (7, False), (7, False), (None, False)])
    assert {r["group_size"] for r in same} == {5}
    assert exact_dedup.exact_dedup(none, counters=counters).count() == 0


def test_repeated_row_stays_once(spark):
    rows = spark.createDataFrame([(3, "a b")] * 40 + [(4, "a  b")], "doc_id long, text string")
    assert Counter(r["kept"] for r in exact_dedup.exact_dedup(rows).collect()) == {True: 1, False: 40}


def test_frequent_candidates_hold_every_heavy_one(spark):
    random.seed(3)
    values = [bytes([v]) for v in [1] * 300 + [2] * 120 + [random.randrange(3, 250) for _ in range(600)]]
    random.shuffle(values)
    frame = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(7)
    found = {bytes(r["digest"]) for r in exact_dedup.frequent_candidates(frame, "digest", 9).collect()}
    assert {bytes([1]), bytes([2])} <= found and len(found) <= 9


def plain_quality(t):
    words = WORD.findall(t)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return *base, len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_quality_counts(edge, docs, texts, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert {i: tuple(r)[1:7] for i, r in got.items()} == {i: plain_quality(t) for i, t in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    got = quality_rules.quality_rules(edge).collect()
    assert Counter((r["doc_id"], *tuple(r)[1:7]) for r in got) == Counter((i, *plain_quality(t or "")) for i, t in EDGE)
    assert quality_rules.quality_rules(none).count() == 0


def test_quality_follows_labels(spark):
    at = "/root/testdata/sf0.01"
    got = queries.op3_quality_rules(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    rate = {(r["quality"], r["long"]): r["k"] for r in got.selectExpr("quality", "n_words >= 50 as long", "int(kept) as k").groupBy("quality", "long").agg({"k": "avg"}).withColumnRenamed("avg(k)", "k").collect()}
    assert rate[1, True] > 0.95
    assert rate[0, True] < 0.3


def test_quality_is_native(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().toString()
    plan += quality_rules.quality_counts(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_kept(rows):
    """(lang, source, text) rows to verdicts, by sorted lists in place of sketches."""
    facts = []
    for lang, source, t in rows:
        t = t or ""
        *base, failed = plain_quality(t)
        words, chars, symbols, dup, repeat = base
        n = {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
        n["n_lines"] = sum(bool(WORD.search(x)) for x in t.split("\n"))
        n["n_letters"], n["n_upper"] = sum(c.isalpha() for c in t), sum(unicodedata.category(c) == "Lu" for c in t)
        n["n_marks"] = t.count("!") + t.count("?")
        rates = {r: math.log1p(n[top]) if below is None else n[top] / n[below] if n[below] else 0.0 for r, (top, below, _) in quality_rules.RATES.items()}
        facts.append(((lang, source), failed, n, rates))

    def quantiles(rate, key):
        own = sorted(f[3][rate] for f in facts if not f[1] and f[0][: len(key)] == key)
        here = [own[max(0, math.ceil(p * len(own)) - 1)] for p in (quality_rules.OUTER, 0.5, 1 - quality_rules.OUTER)]
        if not key:
            return here
        n, w = len(own), quality_rules.PARENT_ROWS
        return [(n * a + w * b) / (n + w) for a, b in zip(here, quantiles(rate, key[:-1]), strict=True)]

    fences = {(r, key): quantiles(r, key) for key in {f[0] for f in facts if not f[1]} for r in quality_rules.RATES}
    for key, failed, n, rates in facts:
        kept = not failed
        for r, (top, below, two) in quality_rules.RATES.items() if kept else ():
            low, mid, high = fences[r, key]
            most, least = mid + quality_rules.REACH * (high - mid), max(0.0, mid - quality_rules.REACH * (mid - low))
            if below is None:
                kept &= least <= rates[r] <= most
            else:
                slack = lambda f: quality_rules.DEVIATIONS * math.sqrt(n[below] * f + 1)  # noqa: B023, E731
                kept &= n[top] <= n[below] * most + slack(most) and (not two or n[top] >= n[below] * least - slack(least))
        yield kept


def test_quality_kept(docs, spark):
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], plain_kept([(r["lang"], r["source"], r["text"]) for r in rows]), strict=True))
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs).collect()}
    assert sum(got[i] != want[i] for i in want) == 0
    # A group that writes differently has fences of its own.
    plain = " ".join(f"word{i}" for i in range(100))
    marks = " ".join(f"word{i}" + "#" * (i % 3) for i in range(100))
    frame = spark.createDataFrame(
        [(i, plain, "en", "a") for i in range(400)] + [(1000 + i, marks, "en", "b") for i in range(400)] + [(2000, marks, "en", "a")], "doc_id long, text string, lang string, source string"
    )
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame).collect()}
    assert not kept[2000] and all(k for i, k in kept.items() if i != 2000)


def plain_spans(t):
    found = []
    for kind, pattern, good in (
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t, re.ASCII) if good(m)]
    return ",".join(x[2] for x in sorted(found))


def test_secret_base_spans(edge, docs, texts, none):
    for frame, rows in ((docs, list(texts.items())), (edge, EDGE)):
        got = secret_scan.scan_secrets(frame).collect()
        base = Counter((r["doc_id"], ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r["spans"] if s.kind != "pair")) for r in got)
        assert base == Counter((i, plain_spans(t or "")) for i, t in rows)
    assert secret_scan.scan_secrets(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "ſecret", "-_."]), max_size=25))
def test_secret_base_spans_any(parts):
    t = "".join(parts)
    assert ",".join(f"{k}:{a}:{b}" for a, k, b in secret_scan.base_spans(t)) == plain_spans(t)


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('const DB_PASS = "tr0ub4dor&3xyz"', "tr0ub4dor&3xyz"),
        ("clientSecret: 'a8F3kLm29QzX77pT'", "a8F3kLm29QzX77pT"),
        ('K = "a8F3kLm29QzX77pT"\nmailer.password = K', "a8F3kLm29QzX77pT"),
        ('A = "a8F3kLm29QzX77pT"\nB = A\nexport SECRET_TOKEN=${B}', "a8F3kLm29QzX77pT"),
        ('{"private_key": "Zm9vYmFyMTIzNDU2Nzg5"}', "Zm9vYmFyMTIzNDU2Nzg5"),
    ],
)
def test_secret_pairs(text, literal):
    spans = [text[a:b] for a, k, b in secret_scan.scan_text(text) if k == "pair"]
    assert spans == [literal]


S = "a8F3kLm29QzX77pT"


@pytest.mark.parametrize(
    ("text", "literals"),
    [
        (f'password: str = "{S}"', [S]),
        (f'password: Optional[str] = "{S}"', [S]),
        (f'password: str | None = "{S}"', [S]),
        (f'const password: string = "{S}"', [S]),
        (f'var apiKey string = "{S}"', [S]),
        (f'char password[] = "{S}";', [S]),
        (f'db.password = K\nK = "{S}"', [S]),
        ('secret = "a8F3kLm2" + "9QzX77pT"', ["a8F3kLm2", "9QzX77pT"]),
        ('secret = ("a8F3kLm2"\n "9QzX77pT")', ["a8F3kLm2", "9QzX77pT"]),
        ('secret = (\n "a8F3kLm29QzX"\n "77pTzzQ81kLm"\n)', ["a8F3kLm29QzX", "77pTzzQ81kLm"]),
        ('secret = ("a8F3kLm29QzX" +\n b"77pTzzQ81kLm")\nx = 1', ["a8F3kLm29QzX", "77pTzzQ81kLm"]),
        (f'passwords = ["{S}", "x8F3kLm29QzX77p"]', [S, "x8F3kLm29QzX77p"]),
        (f'secrets = {{"a": "{S}",\n  "b": ["{S}x"]}}', [S, S + "x"]),
        (f'"Authorization": "Bearer {S}"', [f"Bearer {S}"]),
        (f"FROM x\nENV SECRET_KEY {S}\n", [S]),
        (f"machine h login me password {S}", [S]),
        (f"machine h\nlogin me\npassword {S}\n", [S]),
        (f"private_key: |\n  {S}\n  {S}y\nother: 1", [S, S + "y"]),
        (f'auth: "{S}"', [S]),
        (f'jwt = "{S}"', [S]),
        (f'api_tokens: ["{S}"', [S]),
        (f'password = os.getenv("X", "{S}")', [S]),
        (f'signing_key = b"{S}"', [S]),
        (f'api_key = """{S}"""', [S]),
        (f'#define API_KEY "{S}"', [S]),
        (f"<password>{S}</password>", [S]),
        (f"set_secret('signing_key', '{S}')", [S]),
        (f'set_password("{S}")', [S]),
        (f'K = "hello"\nK = "{S}"\npassword = K', [S]),
        (f'client_auth = "{S}"', [S]),
        (f'config["password"] = "{S}"', [S]),
        (f"'password' => '{S}',", [S]),
        (f'A = "{S}"\nB = A\nC = B\nauth_token = C', [S]),
        (f'a = b\nb = a\npassword = a\nb = "{S}"', [S]),
        (f"# password = {S}", [S]),
    ],
)
def test_secret_syntax(text, literals):
    assert [text[a:b] for a, k, b in secret_scan.scan_text(text) if k == "pair"] == literals


@pytest.mark.parametrize("text", [f'x = "{S}"', "set_secret('signing_key', name)", f'name = "{S}"\nother = name', 'password = "changeme"', 'title = "a8F3kLm29QzX77pT"', "The secret: we were late again", "token = null", "key: value", "monkey = banana split", 'password = os.getenv("X")', "The password Tr0ub4dor was lost", "author: Jonathan Livingston", 'secrets = {"first_key_name": 1}'])
def test_no_secret_pairs(text):
    assert not [k for _, k, _ in secret_scan.scan_text(text) if k == "pair"]


SCAN_PARTS = ["\n", " ", "_", ".", "-", "=", ": ", '"', "'", "x", "Monkey", "a8F3kLm29QzX77pT", "Zm9vYmFyMTIzNDU2Nzg5", *secret_scan.SENSITIVE, "Auth", "API", "Client", "PRIVATE"]


def without_hints(text):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(secret_scan, "hinted", lambda lower: True)
        return secret_scan.scan_text(text)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(SCAN_PARTS), max_size=16))
def test_hints_skip_no_pair(parts):
    t = "".join(parts)
    assert secret_scan.scan_text(t) == without_hints(t)


def test_hints_know_every_sensitive_name():
    names = [*secret_scan.SENSITIVE, *(f"{a}_{b}" for a in secret_scan.SENSITIVE for b in secret_scan.SENSITIVE)]
    names = [n for n in names if secret_scan.name_score(n) >= 2]
    assert {"client_auth", "private_access", "auth_auth"} <= set(names)
    for form in (str, str.upper, str.title):
        for t in (f'{form(n)} = "a8F3kLm29QzX77pT"' for n in names):
            pairs = [s for s in secret_scan.scan_text(t) if s[1] == "pair"]
            assert pairs and secret_scan.scan_text(t) == without_hints(t), t


def test_hints_are_linear():
    for t in ("auth" + "x" * 300_000, "access " * 100_000, "api-" + "a." * 200_000, "autx" * 100_000, "api" + "clien_" * 100_000):
        secret_scan.hinted(t)


def test_redact(spark):
    frame = spark.createDataFrame([(1, 'x password="abcdefgh123" y'), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(frame).collect()}
    assert got[2] is None and got[3] == "clean" and "abcdefgh" not in got[1] and got[1].startswith("x ") and got[1].endswith(" y")


def test_secret_scan_is_linear_on_odd_texts():
    for t in ("a" * 300_000, "a=" * 100_000, "x" + '"' * 200_000, "key=" + "'a\"" * 100_000, "password" + " " * 300_000, "f" * 300_000, "token " * 50_000, "password: " + "a|" * 100_000, "secret('" * 30_000, "token=K+" * 30_000, 'token="a" ' * 50_000, "secret " + "a[0]" * 50_000):
        secret_scan.scan_text(t)


@pytest.fixture(scope="module")
def bytes_library():
    t = Tokenizer.from_file(tokens.tokenizer_file("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def words_library():
    t = Tokenizer.from_file(tokens.tokenizer_file("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


ALPHABET = "ab c' \n\t\r\x0b\x0c\x1c\x85\xa0éÉßİıſK'sT12½²_-,.<|endoftext|><|startoftext|>漢字😀́ 　ŉΣς  "


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    for name, of in (("byte_bpe_50k.json", lambda own, x: [np.frombuffer(p, "<u4").tolist() for p in own.packed(x)]), ("word_bpe_49k.json", lambda own, x: [i for i, _ in own.encode(x)])):
        own, library = both_of(name)
        assert of(own, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'stE.,_#| \n\t\r1²ªµé×÷Ā\xa0ɏɐ漢\x1f\x85", max_size=12), max_size=8), st.integers(1, 4))
def test_chunks_are_the_librarys(parts, n):
    """Texts side by side, with marks after letters and signs, white space at their borders and characters at the ends of the plain range."""
    own, library = both_of("byte_bpe_50k.json")
    got = own.packed(pa.array([None, *parts, "".join(parts) * n])[1:])
    want = [library.encode(t, add_special_tokens=False).ids for t in [*parts, "".join(parts) * n]]
    assert [np.frombuffer(p, "<u4").tolist() for p in got] == want
    assert own.counts([*parts, None]) == [*map(len, want[:-1]), 0]


def test_marks_do_not_make_new_words():
    """A word with a mark behind it is the word, so the library sees each word of a portion once."""
    own, seen = tokens.ByteBpe(tokens.tokenizer_file("byte_bpe_50k.json")), []
    each = own._each
    own._each = lambda words, *rest: seen.extend(words) or each(words, *rest)
    own.packed([f"so {''.join(w)} {''.join(w)}{m} end" for w in itertools.permutations("aeñst", 4) for m in ".,;:!?###***"])
    assert len(seen) == len(set(seen)) < 200


@functools.cache
def both_of(name):
    """The operator's encoder of a file, with small leaves and caches, and the library's."""
    path = tokens.tokenizer_file(name)
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return tokens.ByteBpe(path, 50) if name.startswith("byte") else bpe_codec.WordBpe(path, 50, 7), library


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["'s", "'", "s", "don't", " ", "\n", "1", "22", ",", "...", "é", "É", "漢", "the", "ing", "\xa0", "<|endoftext|>", "x" * 9]), max_size=30), st.integers(1, 12))
def test_text_tree_is_exact(parts, leaf):
    """Leaves cut anywhere, also inside a pre-token, a word or a special token."""
    own, library = both_of("word_bpe_49k.json")
    own.leaf = leaf
    t = "".join(parts)
    [(ids, decoded)] = own.encode([t])
    assert ids == library.encode(t, add_special_tokens=False).ids
    assert decoded == library.decode(ids, skip_special_tokens=False)


def test_trees_are_the_main_path(texts):
    own = bpe_codec.WordBpe(tokens.tokenizer_file("word_bpe_49k.json"))
    long = [t for t in texts.values() if len(t) > bpe_codec.TEXT_LEAF]
    own.encode(long)
    assert len(long) > 100 and own.joins == sum(-(-len(t) // bpe_codec.TEXT_LEAF) - 1 for t in long)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abetho", min_size=1, max_size=300), st.integers(1, 40))
def test_tree_is_exact(run, leaf):
    bpe, _ = both_of("word_bpe_49k.json")
    assert bpe.tree.encode(run, leaf) == bpe.tokenizer.encode(run, add_special_tokens=False).ids


def test_codec(edge, docs, texts, none, words_library):
    for frame, rows in ((docs, list(texts.items())), (edge, EDGE)):
        got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe_codec.encode_decode(frame).collect())
        want = Counter()
        for i, t in rows:
            ids = words_library.encode(t or "", add_special_tokens=False).ids
            want[i, tuple(ids), words_library.decode(ids, skip_special_tokens=False)] += 1
        assert got == want
    assert bpe_codec.encode_decode(none).count() == 0


def test_long_runs_take_the_tree(words_library):
    random.seed(5)
    for letters in ("ab", "the", "é漢a", "=-!"):
        t = "x <|endoftext|> " + "".join(random.choice(letters) for _ in range(9000)) + " y"
        assert bpe_codec.word_bpe("word_bpe_49k.json").encode([t])[0][0] == words_library.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_shortest_pack_first(histogram):
    placed = packing.shortest_pack_first(histogram, 64)
    cells, ranks = Counter(), defaultdict(list)
    for length, rank, n, sequence, offset in placed:
        ranks[length] += range(rank, rank + n)
        for j in range(n):
            for k in range(length):
                cells[sequence + j, offset + k] += 1
    assert {k: len(v) for k, v in ranks.items()} == histogram and all(v == list(range(len(v))) for v in ranks.values())
    assert set(cells.values()) <= {1} and all(k < 64 for _, k in cells)
    fill = Counter(s for s, _ in cells)
    assert all((s, k) in cells for s in fill for k in range(fill[s]))


def test_pack(edge, docs, texts, none, bytes_library):
    for frame, rows in ((docs, list(texts.items())), (edge, EDGE)):
        got = packing.pack(frame, with_ids=True).collect()
        want = Counter()
        for i, t in rows:
            ids = [*bytes_library.encode(t or "", add_special_tokens=False).ids, 1]
            for a in range(0, len(ids), 2048):
                piece = np.array(ids[a : a + 2048], "<u4").tobytes()
                want[i, a, len(piece) // 4, zlib.crc32(piece), len(ids)] += 1
        assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by.values():
            assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert packing.pack(none).count() == 0


def test_padding_is_small(docs):
    total = packing.pack(docs).agg({"length": "sum", "sequence_id": "max"}).head()
    assert total["max(sequence_id)"] + 1 <= 1.01 * total["sum(length)"] / 2048 + 2


def test_sequences(docs):
    packed = packing.pack(docs, with_ids=True)
    made = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048 for r in made)
    assert sum(r["n_tokens"] for r in made) == sum(r["length"] for r in packed.select("length").collect())


def test_salted_ranks(docs, monkeypatch):
    monkeypatch.setattr(packing, "LEAST_RANKED", 1)
    monkeypatch.setattr(packing, "MOST_RANKED", 3)
    got = packing.pack(docs).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def plain_segmentations(word, pieces, table):
    """All ways to cut a word, one by one."""
    if not word:
        return np.ones(table.shape[1])
    total = np.zeros(table.shape[1])
    for n in range(1, len(word) + 1):
        i = pieces.get(word[:n], len(pieces) if n == 1 else None)
        if i is not None:
            total += table[i] * plain_segmentations(word[n:], pieces, table)
    return total


def test_forward_sums_all_segmentations():
    pieces = {p: i for i, p in enumerate(["a", "b", "ab", "ba", "aba", "▁", "▁a"])}
    table = np.vstack([np.random.default_rng(1).random((8, 2)) * 0.3, np.zeros((1, 2))])
    words = ["▁abab", "▁baxa", "▁aaba"]
    want = np.log([plain_segmentations(w, pieces, table) for w in words])
    assert np.allclose(language_id.forward(words, pieces, table), want)
    # Expected counts are the derivatives of log P by log p.
    weights = np.ones((3, 2))
    counts = language_id.expected(words, weights, pieces, table)
    up = table.copy()
    up[2] *= 1 + 1e-6
    assert np.allclose((language_id.forward(words, pieces, up) - want).sum(axis=0) / 1e-6, counts[2], rtol=1e-3)


def test_language_held_out(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_long_words_are_summed_whole():
    pieces = {"▁": 0, "a": 1, "aa": 2, "ab": 3, "b": 4}
    random.seed(4)
    table = np.random.default_rng(1).random((len(pieces) + 2, 3)) * 0.2
    table[-1] = 0
    trie = language_id.Trie(pieces)
    for n in (1, 2, 7, 40, 300):
        w = "▁" + "".join(random.choice("abc") for _ in range(n))
        assert np.allclose(language_id.long_forward(w, table, trie), language_id.forward([w], {}, table, trie)[0])
    got = language_id.long_forward("ab" * 50_000, table, trie)
    assert np.isfinite(got).all() and (got < -10_000).all()


def test_language_edges(edge, docs, none):
    model = language_id.fit(docs, "doc_id", "text", "lang")
    got = language_id.predict(edge, model).collect()
    assert len(got) == len(EDGE)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 13, 14}
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(none, "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language_id.predict(edge, empty).collect()} == {"und"}


def test_token_counts(edge, docs, texts, none, bytes_library):
    for frame, rows in ((docs, list(texts.items())), (edge, EDGE)):
        got = Counter((r["doc_id"], r["n_tokens"]) for r in token_rollup.count_tokens(frame).collect())
        assert got == Counter((i, len(bytes_library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert token_rollup.count_tokens(none).count() == 0


CHANGE = "op string, seq int, doc_id long, tokenizer string, source string, lang string, n_tokens long"


def test_rollup_batches(spark):
    random.seed(9)
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "test"))
    assert rollup.totals().count() == 0
    state: dict = {}
    for batch in range(4):
        rows = []
        for seq in range(60):
            op = random.choice(["insert", "insert", "revise", "delete"])
            rows.append((op, seq, random.randrange(40), random.choice(["t/1", "t/2"]), random.choice(["a", "b", None]), random.choice(["en", None]), random.choice([5, 7, None])))
        rows += [("other", 99, 1, "t/1", "a", "en", 5), ("insert", 99, None, "t/1", "a", "en", 5)]
        for op, _, i, v, source, lang, n in rows[:60]:
            state[i, v] = (source, lang, v, n or 0) if op != "delete" else None
        changes = spark.createDataFrame(rows, CHANGE)
        assert rollup.commit(f"batch/{batch}", changes)
        assert not rollup.commit(f"batch/{batch}", changes)
        want = Counter()
        for s in filter(None, state.values()):
            want[s[:3]] += 1
        got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
        assert got == {k: (n, sum(s[3] for s in state.values() if s and s[:3] == k)) for k, n in want.items()}


def test_rollup_query_equals_a_recount(spark, docs, bytes_library):
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in queries.op10_token_counts(spark, "/root/testdata/sf0.01").collect()}
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        own = want[r["source"], r["lang"], "byte_bpe_50k/1"]
        own[0] += 1
        own[1] += len(bytes_library.encode(r["text"] or "", add_special_tokens=False).ids)
    assert got == {k: tuple(v) for k, v in want.items()}


def test_rollup_compacts_its_ledger(spark, monkeypatch):
    monkeypatch.setattr(token_rollup, "COMPACT_EVERY", 2)
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "compact"))
    for n in range(5):
        rows = [("insert", 0, f"doc{n}", "t/1", "a", "en", 5), ("delete", 0, f"doc{n - 1}", "t/1", "a", "en", None), ("revise", 0, "kept", "t/1", "a", "en", n)]
        rollup.commit(f"b{n}", spark.createDataFrame(rows, CHANGE.replace("doc_id long", "doc_id string")))
        assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t/1", 2, 5 + n)]
    assert rollup._base(5) == 4 and rollup._base(3) == 2
    assert {(r["doc_id"], r["n_tokens"]) for r in rollup.ledger().filter("live").collect()} == {("doc4", 5), ("kept", 4)}


def test_rollup_survives_a_broken_batch(spark):
    path = scratch_path(spark, "broken")
    rollup = token_rollup.TokenRollup(spark, path)
    rows = spark.createDataFrame([("insert", 0, 1, "t/1", "a", "en", 5)], CHANGE)
    rows.write.parquet(f"{path}/ledger/epoch=1")  # what a writer left that died before its marker
    assert rollup.totals().count() == 0
    assert rollup.commit("one", rows)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t/1", 1, 5)]
    assert rollup.commit("none", spark.createDataFrame([], CHANGE))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t/1", 1, 5)]
