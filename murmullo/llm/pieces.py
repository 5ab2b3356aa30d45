"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is a byte-pair model: neighbouring symbols may merge when their join is a piece, the piece
with the best score first, the leftmost among equals. Merge-dropout skips a candidate merge for good when a
keyed hash of (seed, document, places of the two symbols) falls below the dropout rate, so a seed fixes
every segmentation, another seed gives another one, and all decode to the same text. As a skip depends on
the candidate alone, an agenda can run for every blank-separated segment on its own: a round takes the top
of the agendas of all segments of a run of texts at once, with arrays; long segments use a heap each.

Blanks become the mark U+2581 and a text starts with one, as the model asks; a text's own U+2581, like any
character without a piece, is written as bytes, so decoding is exact. Rate 0 gives the plain encoding.

Defined cases: a null or empty text has no ids and decodes to the empty text; a null id is hashed as such,
so its texts are segmented alike; repeated rows get equal ids; an empty table gives an empty result;
other columns are carried only if asked for.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmullo.llm.common import quoted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 11
RUN_CHARS = 1_000_000
LONG = 96  # symbols of a segment from which it gets a heap
MARK = 0x2581
_OWN_MARK = 0x110000  # stands for a mark that the text itself holds
_NEVER = np.int32(2**31 - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Pairs:
    """Merges by pair of symbols: an open-addressed table that is probed for many pairs at once."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged, self.rank = np.zeros(1 << self.bits, np.int32), np.full(1 << self.bits, _NEVER, np.int32)
        for (a, b), (piece, rank) in merges.items():
            slot = int(self._slot(np.array([a << 24 | b]))[0])
            while self.keys[slot] != -1:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.merged[slot], self.rank[slot] = a << 24 | b, piece, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _A) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair; the rank is _NEVER for pairs that don't merge."""
        key = left.astype(np.int64) << 24 | right
        slot = self._slot(key)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            now = self.keys[slot[open_]]
            open_ = open_[(now != key[open_]) & (now != -1)]
        return self.rank[slot], self.merged[slot]


class Pieces:
    """A byte-pair model of SentencePiece read from its file."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        names = [sp.id_to_piece(i) for i in range(size)]
        ids = {names[i]: i for i in range(size) if not special[i]}
        if any("▁" in n.lstrip("▁") for n in ids):
            raise ValueError("a piece of this model spans a blank inside")
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # symbols: pieces, then characters that pieces hold but that are none themselves, then one for all others
        symbols = dict(ids)
        for name in ids:
            for c in name:
                symbols.setdefault(c, size + len(symbols))
        self.other = max(symbols.values()) + 1
        self.size = size
        by_char = np.full(_OWN_MARK + 1, self.other, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                by_char[ord(c)] = i
        self.by_char = by_char
        scores = {n: sp.get_score(i) for n, i in ids.items()}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.merges = {}
        for name, i in ids.items():
            for cut in range(1, len(name)):
                a, b = symbols.get(name[:cut]), symbols.get(name[cut:])
                if a is not None and b is not None:
                    self.merges[a, b] = i, rank[scores[name]]
        self.pairs = Pairs(self.merges)
        # text of each id, marks as blanks
        text = [b"" if special[i] else names[i].replace("▁", " ").encode() for i in range(size)]
        for b, i in enumerate(self.byte_ids.tolist()):
            text[i] = bytes([b])
        self.text = text

    # --- encoding ---

    def encode(self, texts: list[str], keys: np.ndarray, rate: float = 0.0) -> list[np.ndarray]:
        """Ids of each text; ``keys``: an unsigned long for each, from its seed and document."""
        marked = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        sizes = np.array([len(m) + 1 if len(m) else 0 for m in marked], np.int64)
        chars = np.empty(int(sizes.sum()), np.uint32)
        starts = np.cumsum(sizes) - sizes
        for m, at in zip(marked, starts.tolist()):
            if len(m):
                chars[at] = MARK
                chars[at + 1:at + 1 + len(m)] = np.where(m == MARK, _OWN_MARK, np.where(m == 32, MARK, m))
        if not len(chars):
            return [np.empty(0, np.int32) for _ in texts]
        doc = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(chars)) - starts[doc]
        mark = chars == MARK
        head = mark & np.concatenate(([True], ~mark[:-1]))
        head[starts[sizes > 0]] = True
        symbol, begin = self._segments(self.by_char[chars], np.flatnonzero(head), place, keys.astype(np.uint64)[doc], rate)
        # symbols that are no pieces become bytes of their character
        bare = np.flatnonzero(symbol >= self.size)
        if len(bare):
            raw = [chr(MARK if c == _OWN_MARK else c).encode() for c in chars[begin[bare]].tolist()]
            count = np.ones(len(symbol), np.int64)
            count[bare] = [len(r) for r in raw]
            symbol, begin = np.repeat(symbol, count), np.repeat(begin, count)
            symbol[symbol >= self.size] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        cuts = np.searchsorted(begin, np.concatenate((starts, [len(chars)])))
        return [symbol[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _skipped(self, key, start, middle, end, rate):
        # places grow from the left, so the three of them are a candidate
        h = _mix(key + start.astype(np.uint64) * _A + _mix(middle.astype(np.uint64) * _B + end.astype(np.uint64) * _C))
        return h < np.uint64(min(int(rate * 2.0**64), 2**64 - 1)) if rate < 1 else np.ones(len(h), bool)

    def _segments(self, symbol, heads, place, key, rate):
        """Final symbols of all segments in order, and where each begins among the characters."""
        n = len(symbol)
        ends = np.append(heads[1:], n)
        length = ends - heads
        done = []  # (begin, symbol) of finished segments
        for a, b in zip(heads[length >= LONG].tolist(), ends[length >= LONG].tolist()):
            at, found = self._agenda(symbol[a:b].tolist(), place[a], key[a], rate)
            done.append((at + a, found))
        short = np.repeat(length < LONG, length)
        at = np.flatnonzero(short)
        sym, seg = symbol[at], np.repeat(np.arange(len(heads)), length)[at]
        stop = at + 1  # where a symbol ends
        rank, piece = self._rated(sym, at, stop, seg, place, key, rate, np.arange(len(at)))
        while len(at):
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            top = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(at)))
            live = np.repeat(top != _NEVER, size)
            if not live.all():
                done.append((at[~live], sym[~live]))
                at, sym, seg, stop, rank, piece = (x[live] for x in (at, sym, seg, stop, rank, piece))
                if not len(at):
                    break
                top, size = top[top != _NEVER], size[top != _NEVER]
            hits = np.flatnonzero(rank == np.repeat(top, size))
            hits = hits[np.concatenate(([True], seg[hits[1:]] != seg[hits[:-1]]))]  # the leftmost of each segment
            sym[hits], stop[hits] = piece[hits], stop[hits + 1]
            keep = np.ones(len(at), bool)
            keep[hits + 1] = False
            now = hits - np.arange(len(hits))  # places of the merged symbols once their right halves are gone
            at, sym, seg, stop, rank, piece = (x[keep] for x in (at, sym, seg, stop, rank, piece))
            for these in (now, now[now > 0] - 1):
                rank[these], piece[these] = self._rated(sym, at, stop, seg, place, key, rate, these)
        begin, found = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(begin, kind="stable")
        return found[order].astype(np.int32), begin[order]

    def _rated(self, sym, at, stop, seg, place, key, rate, these):
        """Rank and piece of the merge of each symbol in ``these`` with the next one."""
        rank, piece = np.full(len(these), _NEVER, np.int32), np.zeros(len(these), np.int32)
        inner = np.flatnonzero(these + 1 < len(sym))
        i = these[inner]
        inner, i = inner[seg[i] == seg[i + 1]], i[seg[i] == seg[i + 1]]
        r, p = self.pairs.find(sym[i], sym[i + 1])
        if rate:
            some = np.flatnonzero(r != _NEVER)
            j = i[some]
            base = place[at[j]]
            skip = self._skipped(key[at[j]], base, base + (at[j + 1] - at[j]), base + (stop[j + 1] - at[j]), rate)
            r[some[skip]] = _NEVER
        rank[inner], piece[inner] = r, p
        return rank, piece

    def _agenda(self, sym: list[int], place: int, key: np.uint64, rate: float):
        """One segment with a heap; (begin, symbol) of what is left."""
        n = len(sym)
        sym, before, after, stop = list(sym), list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(pairs: list[tuple[int, int]]):
            found = [(a, b, *self.merges[sym[a], sym[b]]) for a, b in pairs if 0 <= a and b < n and (sym[a], sym[b]) in self.merges]
            if rate and found:
                a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
                end = np.array([stop[f[1]] for f in found], np.int64)
                skip = self._skipped(np.full(len(found), key, np.uint64), a + place, b + place, end + place, rate)
                found = [f for f, s in zip(found, skip.tolist()) if not s]
            for a, b, piece, rank in found:
                heapq.heappush(agenda, (rank, a, b, stop[b], piece))

        offer([(i, i + 1) for i in range(n - 1)])
        alive = [True] * n
        while agenda:
            _, a, b, end, piece = heapq.heappop(agenda)
            if not (alive[a] and b < n and alive[b] and after[a] == b and stop[a] == b and stop[b] == end):
                continue  # one of the two has merged since
            sym[a], stop[a], alive[b], after[a] = piece, end, False, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer([(before[a], a), (a, after[a])])
        left = [i for i in range(n) if alive[i]]
        return np.array(left, np.int64), np.array([sym[i] for i in left], np.int32)

    # --- decoding ---

    def decode(self, ids) -> str:
        raw = b"".join([self.text[i] for i in ids])
        return raw[1:].decode() if raw[:1] == b" " else raw.decode()


@functools.lru_cache(2)
def load(model: str) -> Pieces:
    return Pieces(model)


def document_keys(doc_ids: list[int | None], seed: int) -> np.ndarray:
    ids = np.array([-1 if d is None else d for d in doc_ids], np.int64).view(np.uint64)
    return _mix(ids * _A + _mix(np.full(len(ids), seed % 2**64, np.uint64)))


def _runs(texts: list[str]) -> Iterator[slice]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > RUN_CHARS:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode_documents(documents: DataFrame, rate: float = RATE, seed: int = SEED, model: str = MODEL, keep: list[str] | None = None,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ids of every document: the id, n_ids, ids, and ``lossless``: they decode to the text. keep: columns to carry along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            docs = batch.column("id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in _runs(texts):
                ids = pieces.encode(texts[part], document_keys(docs[part], seed), rate)
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                lossless = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts[part])]
                some = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(lossless)]
                    + [some.column(c) for c in kept], ["id", "n_ids", "ids", "lossless", *kept])

    keep = keep or []
    kept = [f"kept_{i}" for i in range(len(keep))]
    narrow = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), *[quoted(c).alias(k) for c, k in zip(keep, kept)])
    kinds = "".join(f", {k} {narrow.schema[k].dataType.simpleString()}" for k in kept)
    out = narrow.mapInArrow(run, "id long, n_ids long, ids array<int>, lossless boolean" + kinds)
    return out.select(F.col("id").alias(id_column), "n_ids", "ids", "lossless", *[F.col(k).alias(c) for c, k in zip(keep, kept)])


def decode_documents(encoded: DataFrame, model: str = MODEL, id_column: str = "doc_id") -> DataFrame:
    """Texts of ids: the id and ``text``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [pieces.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_column).alias("id"), "ids").mapInArrow(run, "id long, text string").withColumnRenamed("id", id_column)
