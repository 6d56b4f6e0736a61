"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. Documents
are indexed segment by segment (a segment is a slice of an Arrow batch, bounded in bytes): postings for the trigrams
that some rule's query names, over ASCII-lower-cased bytes. A rule's query is answered by intersecting and uniting
postings, and its expression runs only over the candidates; a rule without mandatory trigrams runs over every text.
Segments never leave the task that reads them, so there is no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a segment (or one text); bytes whose trigrams are looked up at once.
SEGMENT_BYTES, STEP = 4 << 20, 1 << 20
MOST_EXACT, MOST_CLASS = 64, 8

#: A query: a frozenset of alternatives, each a frozenset of trigrams that must all occur; ANY puts no condition.
Query = frozenset
ANY: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A match counts if the group named by ``group`` (0: the match) has at least ``least`` characters."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


#: Fixed values, the kinds in the order of equal starts. hex: runs of at least 32 are exactly the matches of
#: [0-9a-f]+ with 32 or more characters, since both take whole runs.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 0, 32),
)
#: private_key: with its body (no five dashes) and last line where they follow, else the first line alone.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:(?:[^-]++|-{1,4}(?!-))*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def _both(a: Query, b: Query) -> Query:
    return _least({x | y for x in a for y in b})


def _least(alternatives: set) -> Query:
    """Without alternatives that ask for more than another one does."""
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _of_strings(strings: set[str]) -> Query:
    if not strings or min(map(len, strings)) < 3:
        return ANY
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _ascii_lower(c: int) -> str:
    return chr(c + 32) if 65 <= c <= 90 else chr(c)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    """The finite set of lower-cased strings that a node matches, or None; and the query of a node without such a set."""
    if op is sre.LITERAL:
        return ({_ascii_lower(arg)} if arg < 128 else None), ANY
    if op is sre.AT:
        return {""}, ANY
    if op is sre.IN:
        chars: set[str] | None = set()
        for kind, value in arg:
            if kind is sre.LITERAL and value < 128:
                chars.add(_ascii_lower(value))
            elif kind is sre.RANGE and value[1] < 128:
                chars |= {_ascii_lower(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, ANY
        return (chars if len(chars) <= MOST_CLASS else None), ANY
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST_EXACT:
            return set().union(*(e for e, _ in parts)), ANY
        return None, _least(set().union(*(q if e is None else _of_strings(e) for e, q in parts)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, query = _sequence(body)
        if exact is not None and low == 0 and high == 1:
            return exact | {""}, ANY
        if exact is not None and low == high and len(exact) ** low <= MOST_EXACT:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in exact}
            return out, ANY
        if low == 0:
            return None, ANY
        return None, (query if exact is None else _of_strings(exact))
    return None, ANY


def _sequence(items) -> tuple[set[str] | None, Query]:
    run, query, whole = {""}, ANY, True
    for op, arg in items:
        exact, own = _node(op, arg)
        if exact is not None and len(run) * len(exact) <= MOST_EXACT:
            run = {a + b for a in run for b in exact}
            continue
        whole = False
        query = _both(query, _of_strings(run))
        if exact is None:
            query, run = _both(query, own), {""}
        else:
            run = exact
    return (run, ANY) if whole else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The trigrams, in lower case, that a text with a match must hold; ANY if there are no mandatory ones."""
    exact, query = _sequence(sre_parse.parse(pattern, flags))
    return _of_strings(exact) if exact is not None else query


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        names = sorted({t for _, _, q in self.rules if q != ANY for a in q for t in a})
        self.number = {t: k for k, t in enumerate(names)}
        self.table = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
        for t, k in self.number.items():
            self.table[ord(t[0]) << 16 | ord(t[1]) << 8 | ord(t[2])] = k + 1
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def postings(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a document (column) of a segment holds a trigram (row)."""
        out = np.zeros((len(self.number), len(ends)), bool)
        for lo in range(0, len(data) - 2, STEP):  # one text may be far longer than a segment
            b = self.lower[data[lo : lo + STEP + 2]]
            hit = self.table[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            at = np.flatnonzero(hit)
            doc = np.searchsorted(ends, lo + at, side="right")
            inside = lo + at + 3 <= ends[doc]  # a trigram may not reach into the next document
            out[hit[at][inside].astype(np.int64) - 1, doc[inside]] = True
        return out

    def candidates(self, query: Query, postings: np.ndarray, n: int) -> np.ndarray:
        if query == ANY:
            return np.arange(n)
        found = np.zeros(n, bool)
        for need in query:
            found |= postings[[self.number[t] for t in need]].all(axis=0)
        return np.flatnonzero(found)

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of each text in code points, by start, then in the rules' order."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for lo, hi, raw in self._segments(texts):
            ends = np.cumsum([len(x) for x in raw])
            postings = self.postings(np.frombuffer(b"".join(raw), np.uint8), ends)
            for rule, regex, query in self.rules:
                for k in self.candidates(query, postings, hi - lo):
                    for m in regex.finditer(texts[lo + k] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            out[lo + k].append((rule.kind, m.start(), m.end()))
        for spans in out:
            spans.sort(key=lambda s: s[1])  # stable: the rules' order stays among equal starts
        return out

    @staticmethod
    def _segments(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
        lo, raw, size = 0, [], 0
        for k, text in enumerate(texts):
            raw.append((text or "").encode("utf-8"))
            size += len(raw[-1])
            if size >= SEGMENT_BYTES:
                yield lo, k + 1, raw
                lo, raw, size = k + 1, [], 0
        if raw:
            yield lo, len(texts), raw


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, start, end>>: all matches in the whole text, leftmost and non-overlapping within a kind.

    Null and empty texts give the empty array. Spans of different kinds may overlap.
    """

    @F.arrow_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def spans(texts: pa.Array) -> pa.Array:
        found = _scanner(rules).scan(texts.to_pylist())
        return pa.array([[{"kind": k, "start": a, "end": z} for k, a, z in doc] for doc in found], SPANS)

    return spans(text)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text without its secrets; texts without any, and null, stay as they are."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        found = _scanner(rules).scan(values)
        return pa.array([redact_text(t, s) if s else t for t, s in zip(values, found, strict=True)], pa.string())

    return clean(text)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the spans' order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
