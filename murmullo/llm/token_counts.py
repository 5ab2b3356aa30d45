"""Exact token counts of a byte-level BPE vocabulary by merging whole arrays of pre-tokens.

Texts are cut into pre-tokens. The distinct ones that a run of texts brings are held as one ragged array of byte symbols.
A round finds, for every sequence at once, the pair of neighbouring symbols with the lowest rank, merges all places of that
pair in its sequence from the left (of overlapping places every other one), and rates only the pairs beside a merge
anew; sequences without a pair that merges leave the array. What survives of a sequence are its tokens. A sequence of more than ``LONG`` bytes
keeps its places by rank instead, so that a round touches only the places of its lowest rank.

Every vocabulary file the ``tokenizers`` library reads will do that is a byte-level BPE with the usual pattern.
Special tokens inside a text count as the library counts them by default: one token each, and a border on both sides.

Everything happens inside tasks; no row moves. A task keeps the counts of at most ``MOST_KNOWN`` pre-tokens and starts anew beyond
that.

Defined cases: a null or empty text has no tokens and no bytes; a null id stays null; repeated rows are counted each;
an empty table gives an empty result; other columns are carried only if asked for.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from murmullo.llm.common import quoted
from murmullo.llm.pieces import Pairs

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
LONG = 256  # bytes of a sequence from which its places are kept by rank
RUN_CHARS = 2_000_000
MOST_KNOWN = 500_000
_NEVER = np.int32(2**31 - 1)
# Fixed value: the pattern of byte-level pre-tokens, with white space as Unicode defines it.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"""
    r"""|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
)


def vocabulary_path(name: str) -> str:
    """Place of a vocabulary file: a path as it is, a bare name among the public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of this kind: itself if it is printable, else the next one free from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            raise ValueError("not a byte-level BPE with the usual pattern")
        if spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("a vocabulary with normalisation, ignored merges or dropout")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            raise ValueError("added tokens that take blanks along")
        ids = model["vocab"]
        self.by_byte = np.array([ids[c] for c in byte_letters()], np.int32)
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (ids[a + b], rank))
        self.pairs = Pairs(self.merges)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, special tokens) of a text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text), 0
        parts = self.cut.split(text)
        return [w for p in parts for w in self.words.findall(p)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        found = [self.pre_tokens(t) for t in texts]
        new = list({w for words, _ in found for w in words} - self.known.keys())
        if len(self.known) + len(new) > MOST_KNOWN:
            self.known = {}
            new = list({w for words, _ in found for w in words})
        if new:
            self.known.update(zip(new, self.symbols_left([w.encode() for w in new]).tolist()))
        known = self.known
        return [sum(map(known.__getitem__, words)) + special for words, special in found]

    def symbols_left(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive the merges of each sequence of bytes."""
        size = np.array([len(w) for w in words], np.int64)
        left = np.zeros(len(words), np.int64)
        short = np.flatnonzero(size <= LONG)
        for i in np.flatnonzero(size > LONG).tolist():
            left[i] = self._long(self.by_byte[np.frombuffer(words[i], np.uint8)])
        sym = self.by_byte[np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8)]
        seq = np.repeat(short, size[short])
        rank, made = self._rated(sym, seq, np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            done = lowest == _NEVER
            if done.any():
                left[seq[first[done]]] = count[done]
                live = np.repeat(~done, count)
                sym, seq, rank, made = (x[live] for x in (sym, seq, rank, made))
                lowest, count = lowest[~done], count[~done]
                if not len(sym):
                    break
            hits = _apart(np.flatnonzero(rank == np.repeat(lowest, count)))
            sym[hits] = made[hits]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            now = hits - np.arange(len(hits))
            sym, seq, rank, made = (x[keep] for x in (sym, seq, rank, made))
            these = np.concatenate((now, now[now > 0] - 1))
            rank[these], made[these] = self._rated(sym, seq, these)
        return left

    def _rated(self, sym, seq, these):
        """Rank and product of the pair of each symbol in ``these`` with the next one of its sequence."""
        rank, made = np.full(len(these), _NEVER, np.int32), np.zeros(len(these), np.int32)
        inner = np.flatnonzero(these + 1 < len(sym))
        inner = inner[seq[these[inner]] == seq[these[inner] + 1]]
        rank[inner], made[inner] = self.pairs.find(sym[these[inner]], sym[these[inner] + 1])
        return rank, made

    def _long(self, sym: np.ndarray) -> int:
        """Symbols left of one long sequence: a linked list in arrays, its places in lots by rank."""
        n = len(sym)
        sym, after, before = np.append(sym, -1), np.arange(1, n + 2), np.arange(-1, n)
        alive, rank = np.ones(n + 1, bool), np.full(n + 1, _NEVER, np.int32)
        made = np.zeros(n + 1, np.int32)
        lots: dict[int, list[np.ndarray]] = {}
        agenda: list[int] = []

        def rate(places: np.ndarray) -> None:
            rank[places] = _NEVER
            inner = places[after[places] < n]
            rank[inner], made[inner] = self.pairs.find(sym[inner], sym[after[inner]])
            inner = inner[rank[inner] != _NEVER]
            inner = inner[np.argsort(rank[inner], kind="stable")]
            if not len(inner):
                return
            cuts = np.flatnonzero(np.diff(rank[inner])) + 1
            for lot in np.split(inner, cuts):
                r = int(rank[lot[0]])
                if r not in lots:
                    lots[r] = []
                    heapq.heappush(agenda, r)
                lots[r].append(lot)

        rate(np.arange(n))
        while agenda:
            r = heapq.heappop(agenda)
            places = np.unique(np.concatenate(lots.pop(r)))
            places = places[alive[places] & (rank[places] == r)]
            if not len(places):
                continue
            # of places that follow each other in the list, every other one
            follows = np.concatenate(([False], after[places[:-1]] == places[1:]))
            hits = places[_alternate(follows)]
            gone = after[hits]
            sym[hits] = made[hits]
            alive[gone] = False
            after[hits] = after[gone]
            before[after[hits]] = hits
            n_before = before[hits]
            rate(np.unique(np.concatenate((hits, n_before[n_before >= 0]))))
        return int(alive[:n].sum())


def _alternate(follows: np.ndarray) -> np.ndarray:
    """Every other place, the first included, of each stretch of places that follow each other."""
    place = np.arange(len(follows))
    head = np.maximum.accumulate(np.where(follows, -1, place))
    return (place - head) % 2 == 0


def _apart(hits: np.ndarray) -> np.ndarray:
    return hits[_alternate(np.concatenate(([False], np.diff(hits) == 1)))]


@functools.lru_cache(2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > RUN_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, keep: list[str] | None = None,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every document; keep: columns to carry along."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [n for part in _runs(texts) for n in words.count(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64()), *[batch.column(c) for c in kept]], ["id", "n_bytes", "n_tokens", *kept])

    keep = keep or []
    kept = [f"kept_{i}" for i in range(len(keep))]
    text = F.coalesce(quoted(text_column), F.lit(""))
    narrow = documents.select(quoted(id_column).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"),
                              *[quoted(c).alias(k) for c, k in zip(keep, kept)])
    kinds = "".join(f", {k} {narrow.schema[k].dataType.simpleString()}" for k in kept)
    out = narrow.mapInArrow(run, "id long, n_bytes long, n_tokens long" + kinds)
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                      *[F.col(k).alias(c) for c, k in zip(keep, kept)])
