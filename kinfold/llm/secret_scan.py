"""Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into name-literal pairs and names that take their value from other names;
sensitivity goes from a target through such constants, to a fixpoint, and literals are scored by the names they reach. Three plain patterns (base spans)
are always reported beside them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded, ddl, map_columns

#: Base kinds in order; "pair" is what the lexer adds.
KINDS = ("assign", "access", "hex", "pair")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts of names that receive secrets, and how much each says.
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3, "bearer": 2, "authorization": 3, "jwt": 3, "auth": 2, "private": 1, "access": 1, "api": 1, "key": 1, "signing": 1, "client": 1, "encryption": 1}
#: Texts without a hint hold no name that scores 2 or more: that takes one part of 2 or more, or two others in one name.
STRONG, WEAK = ([p for p, n in SENSITIVE.items() if (n >= 2) == strong] for strong in (True, False))
TWO_WEAK = re.compile(rf"(?:{'|'.join(WEAK)})[a-z0-9_$.\-]*?(?:{'|'.join(WEAK)})")
#: What a base match of kind assign begins with.
ASSIGNED = ("password", "passwd", "secret", "token", "api_key", "apikey")


def hinted(lower: str) -> bool:
    """Whether a lower-case text may hold a sensitive name; plain searches first, as most texts hold none of the parts."""
    return any(p in lower for p in STRONG) or (any(p in lower for p in WEAK) and TWO_WEAK.search(lower) is not None)


NAME = r"(?P<name>[A-Za-z_$][A-Za-z0-9_$]*+(?:[.\-][A-Za-z0-9_$]++)*+)"
#: A name and what makes it a target: a type and "=", an assignment, a key's colon, or the bracket of a call.
TARGET = re.compile(
    rf"""(?<![A-Za-z0-9_$.\-])(?:-{{1,2}}(?=[A-Za-z]))?{NAME}["'`]?(?:\[[0-9]*\]|\])?
        (?:(?:[\x20\t]*+:[\x20\t]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+[?*]?(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z0-9_.]++)*+|[\x20\t]++(?:string|\[\]byte))[\x20\t]*+=(?![=>~])
        |[\x20\t]*+(?P<op>:=|=>|\?=|=(?![=~])|:(?!:)|\())[\x20\t]*+""",
    re.VERBOSE,
)
#: #define NAME and <name>: what follows is the value.
MARKED = re.compile(rf"\#[\x20\t]*+define[\x20\t]++{NAME}[\x20\t]++|<{NAME.replace('name', 'tag')}(?:[\x20\t][^<>\n]*+)?>(?=[^<>\n]++</(?P=tag)>)", re.VERBOSE)
#: A quoted name as an argument, with another argument after it.
KEYED = re.compile(rf"""[\x20\t\n]*+(?P<k>["'`]){NAME}(?P=k)[\x20\t]*+,[\x20\t\n]*+""", re.VERBOSE)
#: A string literal with its prefix, or a bare word.
OPERAND = re.compile(
    r"""(?:[rRbBuUfF]{1,2}(?=["']))?+(?:(?P<t>\"{3}|'{3})(?P<triple>.*?)(?P=t)|(?P<q>["'`])(?P<quoted>(?:(?!(?P=q))[^\\\n]|\\.)*+)(?P=q))
        |\$?\{?(?P<bare>[A-Za-z0-9+/_.~!@%^*$-]++={0,2})\}?""",
    re.VERBOSE | re.DOTALL,
)
#: What joins an operand to the next one: a plus (lines may end there), PHP's dot, or nothing between two literals.
OPEN = re.compile(r"""\([\x20\t\n]*+(?=[rRbBuUfF]{0,2}["'])""")
JOINED = re.compile(r"""[\x20\t]*+(?:\+[\x20\t\n\\]*+|\.[\x20\t]*+(?=["'$])|(?:\\\n[\x20\t]*+)?(?=["']))""")
#: The same inside a bracket, where lines may end anywhere.
JOINED_INSIDE = re.compile(r"""[\x20\t\n\\]*+(?:[+.][\x20\t\n\\]*+)?(?=[rRbBuUfF]{0,2}["'])""")
#: A list or a map of literals: it goes on over literals, plain words, separators and brackets.
CONTAINER = re.compile(r"[\[{(][\x20\t\r\n]*+(?=[\[{(]|[rRbBuUfF]{0,2}[\"'])")
INSIDE = re.compile(
    r"""(?P<open>[\[{(])|(?P<close>[\]})])|(?:[rRbBuUfF]{1,2}(?=["']))?+(?P<q>["'`])(?P<quoted>(?:(?!(?P=q))[^\\\n]|\\.)*+)(?P=q)(?P<key>[\x20\t]*+(?::|=>))?+|[\x20\t\r\n,;:=>+]++|[A-Za-z0-9_.\-]++""",
    re.DOTALL,
)
#: A block of deeper lines, as YAML has it.
BLOCK = re.compile(r"[|>][+\-]?[0-9]?[+\-]?[\x20\t]*+\n")
#: Lines that give a name a value by white space alone: of a container file, and a login's password.
SPACED = re.compile(rf"^[\x20\t]*+(?:ENV|ARG|setenv|SetEnv)[\x20\t]++{NAME}[\x20\t]++|^[^\n]*?\blogin[\x20\t]++[^\s]++[\x20\t\n]++(?P<login>password)[\x20\t]++", re.MULTILINE)
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.\-][A-Za-z0-9_$]+)*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A literal is reported at this score or more.
THRESHOLD = 4.0
SHORTEST = 6
#: Values that stand for no secret.
PLACEHOLDERS = {"none", "null", "true", "false", "undefined", "changeme", "example", "placeholder", "redacted"}


def name_score(name: str) -> int:
    """What the parts of a name say together; plurals count as their singulars."""
    return min(4, sum(SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0)) for p in map(str.lower, PARTS.findall(name))))


def literal_score(literal: str, quoted: bool) -> float:
    """0 for what can't be a secret; else 1 to 4 by length, kinds of characters and entropy."""
    if len(literal) < SHORTEST or literal.lower() in PLACEHOLDERS or len(set(literal)) < 4:
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    return 0.5 * quoted + (kinds >= 2) + (entropy >= 3.0) + 0.5 * (len(literal) >= 16) + (entropy >= 3.5 and kinds >= 2)


class Pairs:
    """The name-literal pairs of a text, and which names stand for which others."""

    def __init__(self) -> None:
        #: (name, whole literal, spans of its parts, quoted)
        self.literals: list[tuple[str, str, list[tuple[int, int]], bool]] = []
        #: target name: names that it takes its value from
        self.sources: dict[str, set[str]] = {}

    def value(self, text: str, name: str, at: int) -> tuple[int, bool]:
        """Reads the operands of an expression from there; gives its end and whether it holds a quoted literal."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        if name_score(name) >= 2:
            self.container(text, name, at)
            self.block(text, name, at)
        if opened := OPEN.match(text, at):
            at = opened.end()
        quoted, end = False, at
        while m := OPERAND.match(text, at):
            group = "triple" if m["t"] is not None else "quoted" if m["q"] is not None else "bare"
            literal, (begin, until) = m[group], m.span(group)
            end = m.end()
            if group == "bare":
                if literal.endswith("+") and text[until : until + 1] in ('"', "'"):  # NAME+"literal"
                    literal, end = literal[:-1], until - 1
                    until -= 1
                if IDENTIFIER.fullmatch(literal):
                    self.sources.setdefault(name, set()).add(literal)
                if text[until : until + 1] == "(":  # a call is no literal, but its fallback may be one
                    if key := KEYED.match(text, until + 1):
                        self.value(text, name, key.end())
                elif not spans and not quoted:
                    self.literals.append((name, literal, [(begin, until)], False))
            elif until > begin:
                quoted = True
                parts.append(literal)
                spans.append((begin, until))
            more = (JOINED_INSIDE if opened else JOINED).match(text, end)
            if not more or (group == "bare" and more.end() == end):
                break
            at = more.end()
        if spans:
            self.literals.append((name, "".join(parts), spans, True))
        return end, quoted

    def container(self, text: str, name: str, at: int) -> None:
        """Every literal of a list or map is a value of its name; keys of a map are none. Names inside are targets of their own."""
        if not CONTAINER.match(text, at):
            return
        depth = 0
        while m := INSIDE.match(text, at):
            at = m.end()
            if m["q"] is not None and m["key"] is None and m["quoted"]:
                self.literals.append((name, m["quoted"], [m.span("quoted")], True))
            depth += (m["open"] is not None) - (m["close"] is not None)
            if depth <= 0:
                return

    def block(self, text: str, name: str, at: int) -> None:
        """The lines of a block that stand deeper than the line of its name are one literal."""
        m = BLOCK.match(text, at)
        if not m:
            return
        begin = text.rfind("\n", 0, at) + 1
        indent = lambda a, b: len(line := text[a:b]) - len(line.lstrip(" \t"))
        own, spans, at = indent(begin, at), [], m.end()
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            if text[at:end].strip():
                if indent(at, end) <= own:
                    break
                spans.append((at + indent(at, end), at + len(text[at:end].rstrip())))
            at = end + 1
        if spans:
            self.literals.append((name, "".join(text[a:b] for a, b in spans), spans, True))

    def scores(self) -> dict[str, int]:
        """What each name says of its literals: its own score, or that of any name that takes its value, to a fixpoint."""
        best = {n: name_score(n) for n in {*self.sources, *(n for n, *_ in self.literals)}}
        known: dict[str, list[str]] = {}
        for n in best:
            known.setdefault(n, []).append(n)
            if (last := re.split(r"[.\-]", n)[-1]) != n:
                known.setdefault(last, []).append(n)
        todo = [n for n in self.sources if best[n] >= 2]
        while todo:
            n = todo.pop()
            for source in self.sources.get(n, ()):
                for k in known.get(source, ()):
                    if best[k] < best[n]:
                        best[k] = best[n]
                        todo.append(k)
        return best


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that a sensitive name receives, directly or through named constants, in any order.

    Targets are assignments with or without a type, keys, tags, #define, ENV lines, logins, calls with one literal, and
    quoted names with the argument after them. Literals may have prefixes or triple quotes, and of those joined together,
    over lines inside a bracket, each is a span; so are those of a list or map, the fallback of a call and each line of a block.
    Comments are read as code, since secrets in them leak too; a name may be assigned several times.
    """
    if not hinted(text.lower()):
        return []
    pairs = Pairs()
    for m in MARKED.finditer(text):
        if m["tag"]:
            pairs.literals.append((m["tag"], text[m.end() : text.index("<", m.end())], [(m.end(), text.index("<", m.end()))], True))
        else:
            pairs.value(text, m["name"], m.end())
    for m in SPACED.finditer(text):
        pairs.value(text, m["name"] or m["login"], m.end())
    at = 0
    while m := TARGET.search(text, at):
        at, name = max(m.end("name"), m.start() + 1), m["name"]
        if m["op"] == "(":
            if key := KEYED.match(text, m.end()):
                end, quoted = pairs.value(text, key["name"], key.end())
                at = end if quoted else key.end("name")
            elif text[m.end() : m.end() + 3].strip("rRbBuUfF")[:1] in ('"', "'", "`"):
                at = pairs.value(text, name, m.end())[0]
            continue
        end, quoted = pairs.value(text, name, m.end())
        at = end if quoted else at
    found: set[tuple[int, int]] = set()
    best = pairs.scores()
    for name, literal, spans, quoted in pairs.literals:
        score = best[name]
        if score >= 2 and (value := literal_score(literal, quoted)) >= 1 and score + value >= THRESHOLD:
            found.update(spans)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three plain patterns, leftmost and without overlap in each kind."""
    lower = text.lower()
    found = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(p in lower for p in ASSIGNED) else []
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def scan_text(text: str) -> list[tuple[int, str, int]]:
    found = base_spans(text)
    found += [(a, "pair", b) for a, b in lexed_spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and spans, an array of (kind, start, end) in code points, end exclusive.

    Spans go by start, then by kind in the order of KINDS. Null and empty texts have none. Rows that repeat an id are
    scanned each by itself; other columns of docs are not read. A text is scanned whole, in one pass of linear size.
    """

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for begin, upto in bounded(batch["text"]):
                spans = [[{"kind": k, "start": a, "end": b} for a, k, b in scan_text(t)] if t else [] for t in batch["text"][begin:upto].to_pylist()]
                yield {"id": batch["id"][begin:upto], "spans": spans}

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_columns(read, scan, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with the same columns, every secret span of the text replaced by the mask (overlapping spans as one).

    Null texts stay null and empty ones empty; rows that repeat an id are masked each by itself; an empty table stays
    empty. Of spans that begin together the longest decides where the text goes on.
    """

    def clean(text: str | None) -> str | None:
        if not text or not (spans := scan_text(text)):
            return text
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for a, b in bounded(batch[text_col]):
                part = {n: v[a:b] for n, v in batch.items()}
                yield {**part, text_col: [clean(t) for t in part[text_col].to_pylist()]}

    return map_columns(docs, scan, ddl(docs.schema))
