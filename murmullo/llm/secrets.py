"""Secret scan over a trigram inverted index.

Each rule is a regular expression. A Boolean query over lower-case byte trigrams is derived from its
syntax tree: whatever text matches must hold those trigrams. Documents are indexed in segments (one per
run of documents inside a task): postings list, for every trigram that some rule asks for, the documents
of the segment that hold it. A rule's query is answered by intersecting and uniting postings, and only
the documents left are verified with the expression itself. A rule without mandatory trigrams is run over
every document. Segments need no shuffle, hold a bounded number of bytes, and are rebuilt from their
input when an executor is lost.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows are scanned each;
other columns are ignored; the result of an empty table is empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op, _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SEGMENT_BYTES = 8 << 20
MOST_STRINGS = 64
MOST_CHOICES = 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    base: bool = False


# The kinds every scan reports, then those this scan adds.
BASE_RULES = (
    Rule("assign", r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|"
         r"(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]{24,}", 24, 0, True),
)
ADDED_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{30,}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._-]+:[^\x20\x09-\x0D/@:]{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + ADDED_RULES


# --- Boolean queries -------------------------------------------------------------------------------
# A query is True (any document), bytes (documents that hold this trigram), ("all", parts) or ("any", parts).

def _all(parts):
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("all", tuple(parts))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("any", tuple(parts))


def _holds(strings):
    """Some string of the set occurs."""
    raw = [s.encode().translate(_LOWER) for s in strings]
    return _any([_all([r[i:i + 3] for i in range(len(r) - 2)]) for r in raw])


# Letters beyond ASCII that match an ASCII letter where case is ignored.
PARTNERS = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _letters(code: int, flags: int) -> set[str] | None:
    """What a literal matches, ASCII letters in lower case as in the index; None for a letter beyond ASCII whose case is ignored."""
    c = chr(code)
    if not flags & re.IGNORECASE:
        return {c.lower() if c.isascii() else c}
    return {c.lower(), *PARTNERS.get(c.lower(), "")} if c.isascii() else None


def _choices(items, flags):
    """Characters of a class, or None if there are many, their case can't be told or the class is negated."""
    found = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes = [value]
        elif kind is op.RANGE and value[1] - value[0] < 2 * MOST_CHOICES:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        some = [_letters(c, flags) for c in codes]
        if None in some:
            return None
        found = found.union(*some)
        if len(found) > MOST_CHOICES:
            return None
    return found


def _analyse(tree, flags):
    """(the finite set of strings it can match or None, what its matches must hold)."""
    exact, clauses, whole = {""}, [], True

    def broken(query=True):
        nonlocal exact, whole
        clauses.append(_holds(exact))
        clauses.append(query)
        exact, whole = {""}, False

    for kind, value in tree:
        if kind is op.LITERAL:
            piece, query = _letters(value, flags), True
        elif kind is op.IN:
            piece, query = _choices(value, flags), True
        elif kind is op.SUBPATTERN:
            piece, query = _analyse(value[3], (flags | value[1]) & ~value[2])
        elif kind is op.BRANCH:
            parts = [_analyse(x, flags) for x in value[1]]
            piece = set().union(*(p for p, _ in parts)) if all(p is not None for p, _ in parts) else None
            query = _any([q for _, q in parts])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            piece, query = _analyse(inner, flags)
            if (least, most) == (0, 1) and piece is not None:
                piece, query = piece | {""}, True
            elif least != most or piece is None or len(piece) > 1 or least > 8:
                piece, query = None, (query if least else True)
            else:
                piece = {p * least for p in piece}
        elif kind is op.AT:
            piece, query = {""}, True
        else:
            piece, query = None, True
        if piece is None:
            broken(query)
        elif len(exact) * len(piece) > MOST_STRINGS:
            broken()
            exact = piece if len(piece) <= MOST_STRINGS else {""}
        else:
            exact = {a + b for a in exact for b in piece}
    clauses.append(_holds(exact))
    return (exact if whole else None), _all(clauses)


def trigram_query(pattern: str):
    """What a document must hold for the pattern to match: True, a trigram, or ("all" | "any", queries)."""
    tree = parser.parse(pattern)
    return _analyse(tree, tree.state.flags)[1]


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


# --- Index segments --------------------------------------------------------------------------------

class Segment:
    """Postings of one run of documents for a set of trigrams."""

    def __init__(self, texts: list[bytes], trigrams: list[bytes], wanted: np.ndarray):
        """wanted: for each of the 2^24 trigrams its place in ``trigrams`` plus one, or 0."""
        self.size, self.trigrams = len(texts), {t: i + 1 for i, t in enumerate(trigrams)}
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(texts).translate(_LOWER), np.uint8).astype(np.int32)
        places = np.empty(0, np.int64)
        term = np.empty(0, np.uint16)
        if len(raw) > 2:
            term = wanted[(raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]]
            places = np.flatnonzero(term)
            term = term[places].astype(np.int64)
        document = np.searchsorted(ends, places, side="right")
        inside = places + 2 < ends[document] if len(places) else np.empty(0, bool)
        postings = np.unique(term[inside] * np.int64(self.size) + document[inside]) if len(places) else places
        self.terms, self.documents = np.divmod(postings, max(self.size, 1))

    def postings(self, trigram: bytes) -> np.ndarray:
        k = self.trigrams[trigram]
        return self.documents[np.searchsorted(self.terms, k):np.searchsorted(self.terms, k, side="right")]

    def search(self, query) -> np.ndarray:
        """Documents that meet a query, in order."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings(query)
        kind, parts = query
        found = None
        for part in parts:
            now = self.search(part)
            if found is None:
                found = now
            elif kind == "all":
                found = np.intersect1d(found, now, assume_unique=True)
            else:
                found = np.union1d(found, now)
            if kind == "all" and not len(found):
                break
        return found


class Scanner:
    """Compiled rules with their queries."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.trigrams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.wanted = np.zeros(1 << 24, np.min_scalar_type(len(self.trigrams)))
        for i, t in enumerate(self.trigrams):
            self.wanted[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For every text its (start, rule, end) in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        segment = Segment([t.encode() for t in texts], self.trigrams, self.wanted)
        for k, rule in enumerate(self.rules):
            for i in segment.search(self.queries[k]).tolist():
                for m in self.compiled[k].finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for x in found:
            x.sort()
        return found


def segments(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of about SEGMENT_BYTES; a longer text is a run of its own. A null text is empty."""
    run, size = [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > SEGMENT_BYTES:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of every document: the id, n_<kind> of each base rule, n_spans, base_sha256 and spans.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then by rule.
    """
    base = [k for k, r in enumerate(rules) if r.base]
    kinds = [r.kind for r in rules]
    schema = pa.schema(
        [("id", pa.int64())] + [(f"n_{rules[k].kind}", pa.int64()) for k in base]
        + [("n_spans", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            found = [x for run in segments(batch.column("text").to_pylist()) for x in scanner.spans(run)]
            said = [[(k, f"{kinds[k]}:{a}:{b}") for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64())]
                + [pa.array([sum(kk == k for kk, _ in x) for x in said], pa.int64()) for k in base]
                + [
                    pa.array(list(map(len, said)), pa.int64()),
                    pa.array([hashlib.sha256(",".join(s for k, s in x if k in base).encode()).hexdigest() for x in said], pa.string()),
                    pa.array([",".join(s for _, s in x) for x in said], pa.string()),
                ],
                schema=schema,
            )

    columns = ", ".join(["id long", *(f"n_{rules[k].kind} long" for k in base), "n_spans long", "base_sha256 string", "spans string"])
    narrow = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(scan, columns).withColumnRenamed("id", id_column)
