"""Secret scans through a trigram inverted index.

Each block of documents (one Arrow batch) is a segment of the index: postings lists of the documents
that hold a trigram, for the trigrams that rules ask for, over bytes with A-Z in lower case. From each
rule's regular expression a Boolean query in disjunctive form is derived; its postings are intersected
and united, and only the candidates are verified with the expression itself. A rule without mandatory
trigrams scans every text. Segments need no shuffle and are rebuilt wherever a task is retried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.batches import texts, utf8


@dataclass(frozen=True)
class Rule:
    """kind: name in spans. pattern: its matches are taken leftmost first and do not overlap.
    least: so many characters must the group (0: the whole match) have, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The base rules, in the order that breaks ties between spans with one start. A maximal run of hex
#: digits has 24 or more of them exactly where the bounded form matches, which is why it stands there.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules, for well-known token formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: An exact string set is followed up to so many strings; beyond, what it has so far goes into the query.
MOST_STRINGS = 64

Query = frozenset[frozenset[str]]
ANY: Query = frozenset({frozenset()})


def _absorb(query: Query) -> Query:
    return frozenset(a for a in query if not any(b < a for b in query))


def _and(a: Query, b: Query) -> Query:
    return _absorb(frozenset(x | y for x, y in product(a, b)))


def _grams(strings: set[str]) -> Query:
    return _absorb(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def trigram_query(pattern: str) -> Query:
    """Alternatives, each a set of trigrams that all occur in every text with a match.

    Trigrams are of UTF-8 bytes with A-Z in lower case, written as texts of one character a byte.

    ANY, the query with one empty alternative, stands for no mandatory trigram.
    """
    query, exact = _follow(sre_parser.parse(pattern))
    return _and(query, _grams(exact))


def _follow(items) -> tuple[Query, set[str]]:
    """The query gathered so far, and the exact strings that may end the sequence."""
    query, exact = ANY, {""}

    def settle(with_strings: set[str]) -> None:
        nonlocal query, exact
        query, exact = _and(query, _grams(with_strings)), {""}

    for op, arg in items:
        strings, inner = _exact(op, arg)
        if strings is not None and len(strings) * len(exact) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        settle(exact)
        if strings is not None:
            exact = strings
        else:
            query = _and(query, inner)
    return query, exact


def _bytes(code: int) -> str:
    return chr(code).encode("utf-8", "surrogatepass").lower().decode("latin-1")


def _exact(op, arg) -> tuple[set[str] | None, Query]:
    """All strings an item matches, or None and the query for it."""
    if op is sre.LITERAL:
        return {_bytes(arg)}, ANY
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return {""}, ANY
    if op is sre.IN and len(arg) <= 8 and all(kind is sre.LITERAL for kind, _ in arg):
        return {_bytes(c) for _, c in arg}, ANY
    if op is sre.SUBPATTERN:
        return _whole(arg[-1])
    if op is sre.BRANCH:
        ways = [_whole(way) for way in arg[1]]
        if all(strings is not None for strings, _ in ways):
            return set().union(*(strings for strings, _ in ways)), ANY
        return None, _absorb(frozenset().union(*(_grams(s) if s is not None else q for s, q in ways)))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, query = _whole(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if least == 0:
            return None, ANY
        return None, _grams(strings) if strings is not None else query
    return None, ANY


def _whole(items) -> tuple[set[str] | None, Query]:
    query, exact = _follow(items)
    plain = all(_exact(op, arg)[0] is not None for op, arg in items)
    if plain and query == ANY:
        return exact, ANY
    return None, _and(query, _grams(exact))


#: Bytes of texts whose trigrams are looked up at a time.
BLOCK = 1 << 22


class Segment:
    """Postings of one block of documents for a fixed set of trigrams."""

    def __init__(self, column: pa.Array, wanted: np.ndarray, table: np.ndarray) -> None:
        data, starts = utf8(column)
        self.postings: dict[int, np.ndarray] = {}
        codes, docs = [], []
        for at in range(0, max(len(data) - 2, 0), BLOCK):
            part = LOWER[data[at : at + BLOCK + 2]].astype(np.uint32)
            code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            hits = np.flatnonzero(table[code])
            doc = np.searchsorted(starts, hits + at, "right") - 1
            inside = hits + at + 2 < starts[doc + 1]
            pair = np.unique(code[hits[inside]].astype(np.uint64) << np.uint64(32) | doc[inside].astype(np.uint64))
            codes.append(pair)
        pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint64)
        code, docs = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for c in wanted:
            lo, hi = np.searchsorted(code, np.uint64(c)), np.searchsorted(code, np.uint64(c), "right")
            self.postings[int(c)] = docs[lo:hi]

    def candidates(self, query: list[list[int]]) -> np.ndarray:
        found = [reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), (self.postings[c] for c in way)) for way in query]
        return reduce(np.union1d, found)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _code(gram: str) -> int:
    a, b, c = gram.encode("latin-1")
    return a << 16 | b << 8 | c


def spans_of(text: str, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Spans of a rule in one text, in code points."""
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id and spans (kind, start, end), by start, then in the order of the rules.

    Offsets count code points; ends are exclusive. Null and empty texts have no spans. Rows with null
    ids and repeated rows are scanned like all others. Empty tables give no rows; other columns are
    ignored. Texts are scanned whole, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        coded = [None if frozenset() in q else [[_code(g) for g in way] for way in q] for q in queries]
        patterns = [r.compiled() for r in rules]
        wanted = np.unique([c for q in coded if q for way in q for c in way]).astype(np.uint32)
        table = np.zeros(1 << 24, bool)
        table[wanted] = True
        for batch in batches:
            column = texts(batch.column(1))
            segment = Segment(column, wanted, table)
            values = column.to_pylist()
            found: dict[int, list] = {}
            for rank, (rule, query, pattern) in enumerate(zip(rules, coded, patterns)):
                for k in range(len(values)) if query is None else segment.candidates(query).tolist():
                    for start, end in spans_of(values[k], rule, pattern):
                        found.setdefault(k, []).append((start, rank, end))
            spans = [[{"kind": rules[rank].kind, "start": a, "end": b} for a, rank, b in sorted(found.get(k, ()))] for k in range(len(values))]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
