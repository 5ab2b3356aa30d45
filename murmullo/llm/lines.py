"""Line deduplication by an exact set-similarity join.

A line is the set of its words; a line goes when an earlier one (by doc_id and line number), kept or not,
has a Jaccard similarity of at least ``percent`` / 100. Steps:

* rarity: hashed word counts over all lines, a table of fixed size, order the words of every line from
  rare to common (longer words first among equals, then by hash). Any order gives right results; a rare
  start keeps the groups below small.
* classes: lines with equal sets are one class, known by its first line; the others match that one.
* prefix, position and length: two sets can only be similar if they share a word among their first
  n - ceil(t n) + 1, if their sizes are close, and if what follows the shared words suffices. Classes meet
  in one group per prefix word; words too frequent for one group are split into pairs of salted blocks.
  A bitmap of each set (its words' bits, added without carry) bounds the difference of two sets from below and drops most
  of the rest.
* verification: candidates' words are read again from the documents that a fixed-size bitmap of the
  lines in question lets through, and the Jaccard similarity is computed on the sets.

A large group gives each line its ``MOST`` closest candidates at first; lines that none of these removes
and that have more are joined again with all of theirs, so nothing is lost.

Words are compared by 64-bit hashes. Defined cases: blank lines stay and match nothing (so do
lines of fewer than ``least`` distinct words, if more than one is asked for); null texts have no lines; documents without id stay as they are; ids
are taken as unique: rows that repeat a document share its decisions; ties don't arise, as places
differ; an empty table gives an empty result; other columns are ignored or carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from murmullo.llm.common import fresh, quoted
from murmullo.session import materialize

PERCENT, LEAST = 80, 1
BUCKET_BITS, CHUNK_BITS = 20, 12
SEEN_BITS = 24
RUN_BYTES = 2 << 20
ROWS = 256  # texts of a batch that are taken from it at a time
PAIRS = 1 << 18  # pairs of entries compared at a time, about
GROUP = 64  # groups up to this size give all candidates at once
MOST, SURE = 16, 4
BLOCK_ENTRIES = 500_000  # entries of a word from which its group is split
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lines:
    """Word sets of the lines of some texts: for each line with a word its doc (index), line number and words."""

    def __init__(self, parts: list[tuple[int, int, bytes]], levels: np.ndarray | None = None, wanted: np.ndarray | None = None):
        """parts: (doc, number of the first line, text); levels: rarity of each bucket, the order without it is by hash;
        wanted: flags of buckets, lines without a word in one of them are left out."""
        raw, starts, size, words = self._hashed(parts)
        breaks = np.flatnonzero(raw == 10)
        line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(starts, breaks), prepend=0))  # number among all lines
        if wanted is not None:
            held = np.zeros(len(breaks), bool)
            held[line[wanted[(words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]]] = True
            held = held[line]
            words, line, size = words[held], line[held], size[held]
        order = self._order(words, line, size, levels)
        words, line = words[order], line[order]
        once = np.ones(len(words), bool)
        once[1:] = (words[1:] != words[:-1]) | (line[1:] != line[:-1])
        self.words, line = words[once], line[once]
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.empty(0, np.int64)
        self.first, self.sizes = first, np.diff(np.append(first, len(line)))
        counts = np.array([p[2].count(b"\n") + 1 for p in parts], np.int64)
        begin = np.cumsum(counts) - counts
        at = line[first]
        part = np.searchsorted(begin, at, side="right") - 1
        self.doc = np.array([p[0] for p in parts], np.int64)[part]
        self.line = at - begin[part] + np.array([p[1] for p in parts], np.int64)[part]

    @staticmethod
    def _hashed(parts):
        """The bytes of all parts, and start, length and hash of every word.

        Words are read in pieces of eight bytes, the last filled with zeros; a piece is mixed with its number.
        """
        data = b"\n".join(p[2] for p in parts) + b"\n" + bytes(8)
        raw = np.frombuffer(data, np.uint8)[:-8]
        space = _SPACE[raw]
        edges = np.flatnonzero(np.diff(space, prepend=True))  # a word begins, it ends, and so on; the last byte is a space
        starts, size = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            return raw, starts, size, np.empty(0, np.uint64)
        eights = np.ndarray((len(raw),), "<u8", data, strides=(1,))
        words = _mix((eights[starts] & _FILLED[np.minimum(size, 8)]) ^ _K)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) >> 3  # pieces after the first
            first = np.cumsum(more) - more
            number = np.arange(1, first[-1] + more[-1] + 1) - np.repeat(first, more)
            held = eights[np.repeat(starts[long], more) + 8 * number] & _FILLED[np.minimum(np.repeat(size[long], more) - 8 * number, 8)]
            words[long] += np.add.reduceat(_mix(held ^ (number.astype(np.uint64) + np.uint64(1)) * _K), first)
        words = _mix(words + size.astype(np.uint64) * _K)
        return raw, starts, size, words

    @staticmethod
    def _order(words, line, size, levels):
        """Order by line, then rarity, then length, then hash."""
        level = np.zeros(len(words), np.uint64) if levels is None else levels[(words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64)
        short = np.uint64(63) - np.minimum(size, 63).astype(np.uint64)
        tail = (level << np.uint64(34)) | (short << np.uint64(28))
        key = (line.astype(np.uint64) << np.uint64(42)) | tail | (words >> np.uint64(36))
        order = np.argsort(key)
        key = key[order]
        tied = key[1:] == key[:-1]
        if (words[order[1:][tied]] != words[order[:-1][tied]]).any():  # the short hash of two words of a line is the same
            order = np.lexsort((words, tail, line))
        return order

    def chosen(self, least: int) -> np.ndarray:
        return np.flatnonzero(self.sizes >= least)

    def prefixes(self, percent: int) -> np.ndarray:
        """How many of the first words of each line are its keys: similar lines share one of them."""
        return self.sizes - (percent * self.sizes + 99) // 100 + 1


def parts(texts: Iterable[bytes | None], ids: list) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of about RUN_BYTES of the texts that have an id; a long text is cut between lines."""
    run, size = [], 0
    for i, (raw, doc) in enumerate(zip(texts, ids)):
        if not raw or doc is None:
            continue
        at, line = 0, 0
        while at < len(raw):
            end = len(raw)
            if end - at > RUN_BYTES:
                end = raw.find(b"\n", at + RUN_BYTES)
                end = len(raw) if end < 0 else end
            run.append((i, line, raw[at:end]))
            size += end - at
            line += run[-1][2].count(b"\n") + 1
            at = end + 1
            if size >= RUN_BYTES:
                yield run
                run, size = [], 0
    if run:
        yield run


def _raw(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    """The texts of a batch in UTF-8, as they lie there, a few copied at a time."""
    for at in range(0, batch.num_rows, ROWS):
        yield from batch.column("text").slice(at, ROWS).cast(pa.binary()).to_pylist()


def rarity(documents: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(level, count) of each of the 2^BUCKET_BITS word buckets over all words; both tables have a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for some in parts(_raw(batch), batch.column("id").to_pylist()):
                words = Lines._hashed(some)[3]
                counts += np.bincount((words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
        chunks = np.minimum(counts, 2**31 - 1).astype(np.int32).reshape(-1, 1 << CHUNK_BITS)
        used = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunks[k].tobytes() for k in used], pa.binary())], ["chunk", "counts"])

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in group:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])

    kinds = "chunk int, counts binary"
    summed = documents.select("id", "text").mapInArrow(run, kinds).repartition("chunk").mapInArrow(add, kinds)
    counts = np.zeros((1 << (BUCKET_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    for r in summed.collect():  # at most 2^BUCKET_BITS numbers
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    counts = counts.ravel()
    return np.minimum(4 * np.log2(counts + 1), 255).astype(np.uint8), counts


def _firsts(order: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """For rows in an order, where the run of equal columns begins that each belongs to."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    return np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


SET = "cls long, n int, s0 long, s1 long, doc long, line int, keys array<long>"


def _sets(documents: DataFrame, levels: np.ndarray, percent: int, least: int, wanted: np.ndarray | None = None) -> DataFrame:
    """Classes of lines by task: class (cls, n, s0, s1), first place (doc, line) and prefix words, rare first.

    Copies of a line within a run of texts are settled at once, so a line found everywhere is a row per run
    at most; they are passed on, dealt by their own place, as rows with n = 0 and the place of the earlier line in s0 and s1.
    """
    held = documents.sparkSession.sparkContext.broadcast((levels, wanted))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, wanted = held.value
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for some in parts(_raw(batch), ids):
                x = Lines(some, levels, wanted)
                at = x.chosen(least)
                if wanted is not None:  # lines with a wanted word among those that make their keys
                    early = np.arange(len(x.words)) < np.repeat(x.first + x.prefixes(percent), x.sizes)
                    hit = early & wanted[(x.words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                    at = at[np.logical_or.reduceat(hit, x.first)[at]] if len(x.first) else at
                if not len(at):
                    continue
                half = (x.words >> np.uint64(12)) & np.uint64(1) == 1  # a word's bit lies in one of the two longs
                bits = [np.uint64(1) << (x.words >> np.uint64(s) & np.uint64(63)) for s in (0, 6)]
                bits = [np.where(half, bits[0], np.uint64(0)), np.where(half, np.uint64(0), bits[1])]
                s0, s1 = (np.bitwise_xor.reduceat(b, x.first)[at].astype(np.int64) for b in bits)
                cls, n = np.add.reduceat(_mix(x.words ^ _K), x.first)[at].astype(np.int64), x.sizes[at]
                doc, line = np.array([ids[i] for i in x.doc[at].tolist()], np.int64), x.line[at]
                order = np.lexsort((line, doc, s1, s0, n, cls))
                first = order[_firsts(order, [cls, n, s0, s1])]
                copy = np.flatnonzero((first != order) & ((doc[first] != doc[order]) | (line[first] != line[order])))
                own, to = order[first == order], first[copy]
                copy = order[copy]
                length = x.prefixes(percent)[at][own]
                offsets = np.concatenate(([0], np.cumsum(length)))
                place = np.repeat(x.first[at][own] - offsets[:-1], length) + np.arange(offsets[-1])
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate((offsets, np.full(len(copy), offsets[-1]))), pa.int32()), pa.array(x.words[place].astype(np.int64)))
                both = np.concatenate((own, copy))
                # a settled copy needs no meeting with its class: it is dealt by its own place
                dealt = np.concatenate((cls[own], _mix(doc[copy].view(np.uint64) * _K + line[copy].astype(np.uint64)).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dealt), pa.array(np.concatenate((n[own], np.zeros(len(copy), np.int64))), pa.int32()),
                     pa.array(np.concatenate((s0[own], doc[to]))), pa.array(np.concatenate((s1[own], line[to]))),
                     pa.array(doc[both]), pa.array(line[both], pa.int32()), keys], ["cls", "n", "s0", "s1", "doc", "line", "keys"])

    return documents.select("id", "text").mapInArrow(run, SET)


ENTRY = "key long, doc long, at long, n int, s0 long, s1 long"


def _entries(sets: DataFrame, counts: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """An entry for each prefix word of each class: key, first place (doc; line and place of the word in at), n, s0, s1.

    A word counted more than BLOCK_ENTRIES times has a key for each pair of blocks of lines. Copies, found
    here or before, are entries with n = 0 and the place of the earlier line in s0 and s1.
    """
    splits = np.maximum(1, -(-counts // BLOCK_ENTRIES)).astype(np.int64)
    held = sets.sparkSession.sparkContext.broadcast((splits if splits.max() > 1 else None, wanted))  # fixed size

    def out(key, doc, line, spot, n, s0, s1):
        at = line.astype(np.int64) << 32 | spot
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, doc, at)] + [pa.array(n, pa.int32()), pa.array(s0), pa.array(s1)], ["key", "doc", "at", "n", "s0", "s1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        cls, n, s0, s1, doc, line = (table.column(c).to_numpy() for c in ("cls", "n", "s0", "s1", "doc", "line"))
        keys = table.column("keys")
        ends, words = np.asarray(keys.offsets).astype(np.int64), keys.values.to_numpy()
        done = np.flatnonzero(n == 0)
        if len(done):
            yield out(cls[done], doc[done], line[done], np.zeros(len(done), np.int64), n[done], s0[done], s1[done])
        order = np.lexsort((line, doc, s1, s0, n, cls))
        order = order[n[order] > 0]
        first = order[_firsts(order, [cls, n, s0, s1])] if len(order) else order
        copy = (first != order) & ((doc[first] != doc[order]) | (line[first] != line[order]))
        if copy.any():
            c, to = order[copy], first[copy]
            spread = _mix(doc[c].view(np.uint64) * _K + line[c].astype(np.uint64)).view(np.int64)
            yield out(spread, doc[c], line[c], np.zeros(len(c), np.int64), np.zeros(len(c), np.int32), doc[to], line[to].astype(np.int64))
        own = order[first == order]
        splits, wanted = held.value
        for at in range(0, len(own), 20_000):
            o = own[at:at + 20_000]
            length = ends[o + 1] - ends[o]
            row = np.repeat(o, length)
            spot = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            word = words[ends[row] + spot]
            if wanted is not None:
                hit = wanted[(word.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                row, spot, word = row[hit], spot[hit], word[hit]
            if splits is not None:
                many = splits[(word.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                again = np.repeat(np.arange(len(row)), many)
                other = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
                row, spot, word, many = row[again], spot[again], word[again], many[again]
                block = (cls[row].view(np.uint64) % many.astype(np.uint64)).astype(np.int64)
                pair = (np.minimum(block, other) << 31 | np.maximum(block, other)).astype(np.uint64)
                word = np.where(many > 1, _mix(word.view(np.uint64) + (pair + np.uint64(1)) * _K).view(np.int64), word)
            yield out(word, doc[row], line[row], spot, n[row], s0[row], s1[row])

    return sets.repartition("cls").mapInArrow(run, ENTRY)


def _gathered(batches: Iterator[pa.RecordBatch]):
    """All batches of a partition as one, or None without rows. Partitions are sized by Spark, and no key has many rows."""
    some = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(some).combine_chunks().to_batches(max_chunksize=1 << 40)[0] if some else None


CANDIDATE, MORE, COPY = 0, 1, 2
PAIR = "doc long, line int, to_doc long, to_line int, kind int"


def _near(a: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of entries pass the length, position and bitmap filters."""
    # each filter looks only at the pairs that the one before has left
    n, m = a["n"][i], a["n"][j]
    ok = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    i, j, n, m = i[ok], j[ok], n[ok], m[ok]
    need = (percent * (n + m) + 99 + percent) // (100 + percent)
    p, q = a["spot"][i], a["spot"][j]
    far = np.flatnonzero(np.minimum(p, q) + np.minimum(n - p, m - q) >= need)
    ok, i, j, room = ok[far], i[far], j[far], (n + m - 2 * need)[far]
    # as unsigned numbers: bits of negative ones are counted in their absolute value
    apart = sum(np.bitwise_count((a[s][i] ^ a[s][j]).view(np.uint64)).astype(np.int64) for s in ("s0", "s1"))
    return ok[apart <= room]


def _candidates(entries: DataFrame, percent: int, most: int | None, asking: np.ndarray | None = None) -> DataFrame:
    """Lines and earlier ones that may be similar, with the kind of the pair; copies are passed on.

    With ``most``, lines of large groups get that many candidates, those with the fewest differing bits, and
    lines that can have more say so. asking: table of the lines that ask (others are only asked); None: all ask.
    """
    held = entries.sparkSession.sparkContext.broadcast(asking)  # fixed size

    def emit(a, i, j, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(a["doc"][j]), pa.array(a["line"][j], pa.int32()), pa.array(a["doc"][i]), pa.array(a["line"][i], pa.int32()), pa.array(kind, pa.int32())],
            ["doc", "line", "to_doc", "to_line", "kind"])

    def small(a, starts, size):
        x, y = np.triu_indices(size, 1)
        step = max(1, PAIRS // len(x))
        for at in range(0, len(starts), step):
            base = starts[at:at + step, None]
            i, j = (base + x).ravel(), (base + y).ravel()
            if a["asks"] is not None:
                asked = a["asks"][j]
                i, j = i[asked], j[asked]
            ok = _near(a, i, j, percent)
            if len(ok):
                yield emit(a, i[ok], j[ok], np.full(len(ok), CANDIDATE))

    def closest(a, i, j, more, base):
        """The ``most`` pairs of each line with the fewest differing bits; ``more`` (from ``base``) marks lines that lose some."""
        apart = sum(np.bitwise_count((a[s][i] ^ a[s][j]).view(np.uint64)).astype(np.int64) for s in ("s0", "s1"))
        order = np.lexsort((i, apart, j))
        i, j = i[order], j[order]
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        more[j[rank >= most] - base] = True
        return i[rank < most], j[rank < most]

    def large(a, start, end):
        """Entries of one group in order of place, against all earlier ones, block by block.

        A line with ``SURE`` candidates that differ in few bits asks no further: one of these will do.
        """
        probes = np.arange(start, end) if a["asks"] is None else start + np.flatnonzero(a["asks"][start:end])
        for at in range(0, len(probes), PAIRS // 1024):
            j = probes[at:at + PAIRS // 1024]
            base = int(j[0])
            more, sure = np.zeros(int(j[-1]) - base + 1, bool), np.zeros(len(j), np.int64)
            left, right = np.empty(0, np.int64), np.empty(0, np.int64)
            for b in range(start, int(j[-1]), 1024):
                block = np.arange(b, min(b + 1024, int(j[-1])))
                open_ = np.flatnonzero(sure < SURE) if most else np.arange(len(j))
                if not len(open_):
                    break
                jj, ii = np.repeat(open_, len(block)), np.tile(block, len(open_))
                before = ii < j[jj]
                jj, ii = jj[before], ii[before]
                ok = _near(a, ii, j[jj], percent)
                jj, ii = jj[ok], ii[ok]
                if most and len(jj):
                    n, m = a["n"][ii], a["n"][j[jj]]
                    room = n + m - 2 * ((percent * (n + m) + 99 + percent) // (100 + percent))
                    apart = sum(np.bitwise_count((a[s][ii] ^ a[s][j[jj]]).view(np.uint64)).astype(np.int64) for s in ("s0", "s1"))
                    sure += np.bincount(jj[2 * apart <= room], minlength=len(j))
                left, right = np.concatenate((left, ii)), np.concatenate((right, j[jj]))
                if most and len(left) > 200_000:
                    left, right = closest(a, left, right, more, base)
            if most:
                left, right = closest(a, left, right, more, base)
                more[j[sure >= SURE] - base] = True  # not all earlier ones were looked at
            if len(left):
                yield emit(a, left, right, np.where(more[right - base], MORE, CANDIDATE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        a = {c: table.column(c).to_numpy() for c in ("key", "doc", "at", "n", "s0", "s1")}
        done = a["n"] == 0
        if done.any():
            line, to_line = (a["at"][done] >> 32).astype(np.int32), a["s1"][done].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a["doc"][done]), pa.array(line), pa.array(a["s0"][done]), pa.array(to_line), pa.array(np.full(len(line), COPY, np.int32))],
                ["doc", "line", "to_doc", "to_line", "kind"])
        order = np.flatnonzero(~done)
        order = order[np.argsort(a["key"][order])]
        key = a["key"][order]
        alone = np.ones(len(order), bool)  # words of one class only
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        order = order[~alone]
        order = order[np.lexsort((a["at"][order], a["doc"][order], a["key"][order]))]
        a = {c: x[order] for c, x in a.items()}
        a["line"], a["spot"], a["n"] = a["at"] >> 32, a["at"] & 0xFFFFFFFF, a["n"].astype(np.int64)
        a["asks"] = None if held.value is None else _asked(held.value, a["doc"], a["line"])
        first = np.flatnonzero(np.concatenate(([True], a["key"][1:] != a["key"][:-1]))) if len(order) else order
        sizes = np.diff(np.append(first, len(order)))
        for size in np.unique(sizes[sizes <= GROUP]).tolist():
            yield from small(a, first[sizes == size], size)
        for k in np.flatnonzero(sizes > GROUP).tolist():
            yield from large(a, int(first[k]), int(first[k] + sizes[k]))

    return entries.repartition("key").mapInArrow(run, PAIR)


def _spot(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Bit of a line in the table of lines in question."""
    return (_mix(doc.astype(np.uint64) * _K + line.astype(np.uint64)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


def _asked(table: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which lines have their bit set in a table of lines in question."""
    spot = _spot(doc, line)
    return table[spot >> 3] & (128 >> (spot & 7)) != 0


def _in_question(pairs: DataFrame) -> np.ndarray:
    """A table of 2^SEEN_BITS bits with those of all lines in the pairs set, eight to a byte: workers keep it so."""
    ends = pairs.select("doc", "line").union(pairs.select("to_doc", "to_line")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
        for batch in batches:
            spot = _spot(batch.column("doc").to_numpy(), batch.column("line").to_numpy())
            np.bitwise_or.at(seen, spot >> 3, (128 >> (spot & 7)).astype(np.uint8))
        chunks = seen.reshape(-1, 1 << 12)
        used = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunks[k].tobytes() for k in used], pa.binary())], ["chunk", "bits"])

    def unite(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in group:
            for k, raw in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
                total[k] = total.get(k, 0) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "bits"])

    kinds = "chunk int, bits binary"
    table = np.zeros((1 << (SEEN_BITS - 15), 1 << 12), np.uint8)
    for r in ends.mapInArrow(run, kinds).repartition("chunk").mapInArrow(unite, kinds).collect():  # at most 2^SEEN_BITS bits
        table[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return table.ravel()


def _words_of(docs: DataFrame, pairs: DataFrame, least: int, levels: np.ndarray | None = None, percent: int | None = None) -> DataFrame:
    """doc, line and words of the lines in the pairs, and of the few others that share a bit with them; with ``percent`` only
    the words that are their keys in the order of ``levels``."""
    held = docs.sparkSession.sparkContext.broadcast((_in_question(pairs), levels))  # fixed size

    def out(x: Lines) -> pa.RecordBatch:
        at = x.chosen(least)
        sizes = (x.sizes if percent is None else x.prefixes(percent))[at]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        place = np.repeat(x.first[at] - offsets[:-1], sizes) + np.arange(offsets[-1])
        words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.words[place].astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(x.doc[at]), pa.array(x.line[at].astype(np.int32)), words], ["doc", "line", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, levels = held.value
        some, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                texts, ids = list(_raw(rows)), rows.column("id").to_pylist()
                block = [i for i, doc in enumerate(ids) if texts[i] and doc is not None]
                if not block:
                    continue
                n = np.array([texts[i].count(b"\n") + 1 for i in block])
                line = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                asked = np.flatnonzero(_asked(seen, np.repeat(np.array([ids[i] for i in block], np.int64), n), line))
                owner = np.repeat(np.array(block), n)[asked].tolist()
                last, whole = None, []
                for i, k in zip(owner, line[asked].tolist()):
                    if i != last:
                        last, whole = i, texts[i].split(b"\n")
                    some.append((ids[i], k, whole[k]))
                    size += len(whole[k])
                    if size >= RUN_BYTES:
                        yield out(Lines(some, levels))
                        some, size = [], 0
        if some:
            yield out(Lines(some, levels))

    return docs.select("id", "text").mapInArrow(run, "doc long, line int, words array<long>")


def _words_wanted(docs: DataFrame, asked: DataFrame, levels: np.ndarray, percent: int, least: int) -> np.ndarray:
    """A flag for each word bucket: some line asked about has a key in it. Similar lines share a key, so one of these."""
    words = _words_of(docs, asked, least, levels, percent).select(F.explode("words").alias("word"))
    bucket = F.shiftrightunsigned("word", 64 - BUCKET_BITS).alias("bucket")
    flags = np.zeros(1 << BUCKET_BITS, bool)
    for r in words.select(bucket).distinct().collect():  # at most 2^BUCKET_BITS numbers
        flags[r["bucket"]] = True
    return flags


def _verified(docs: DataFrame, pairs: DataFrame, percent: int, least: int) -> DataFrame:
    """Pairs whose sets are similar, the earliest partner of each line."""
    words = materialize(_words_of(docs, pairs, least), "words")
    left = words.select("doc", "line", F.col("words").alias("a"))
    right = words.select(F.col("doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("words").alias("b"))
    both = pairs.select("doc", "line", "to_doc", "to_line").join(left, ["doc", "line"]).join(right, ["to_doc", "to_line"])
    both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
    both = both.where(100 * F.col("common") >= percent * (F.size("a") + F.size("b") - F.col("common")))
    return both.groupBy("doc", "line").agg(F.min(F.struct("to_doc", "to_line")).alias("to")).select("doc", "line", "to.*")


def removed_lines(documents: DataFrame, percent: int = PERCENT, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Lines that go: doc, line (from 0), and to_doc, to_line, an earlier line that is similar."""
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    levels, counts = rarity(docs)
    entries = _entries(_sets(docs, levels, percent, least), counts)
    pairs = _candidates(entries, percent, MOST)
    pairs = materialize(pairs.groupBy("doc", "line", "to_doc", "to_line").agg(F.max("kind").alias("kind")), "candidates")
    similar = materialize(_verified(docs, pairs.where(F.col("kind") != COPY), percent, least), "similar")
    # lines with more candidates than they were given and none among these that fits
    rest = materialize(pairs.where(F.col("kind") == MORE).select("doc", "line").distinct().join(similar, ["doc", "line"], "left_anti"), "rest")
    if not rest.isEmpty():
        asked = rest.select("doc", "line", F.col("doc").alias("to_doc"), F.col("line").alias("to_line"))
        wanted = _words_wanted(docs, asked, levels, percent, least)
        few = _entries(_sets(docs, levels, percent, least, wanted), counts, wanted)
        others = _candidates(few, percent, None, _in_question(asked)).where(F.col("kind") != COPY).drop("kind").distinct()
        similar = similar.union(_verified(docs, materialize(others, "candidates"), percent, least))
    copies = pairs.where(F.col("kind") == COPY).select("doc", "line", "to_doc", "to_line")
    return copies.union(similar).groupBy("doc", "line").agg(F.min(F.struct("to_doc", "to_line")).alias("to")).select("doc", "line", "to.*")


def deduplicate(documents: DataFrame, percent: int = PERCENT, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with the lines that go cut from the text, and ``removed_lines`` and ``similar_docs`` (arrays, empty if none).

    All columns are kept; the two new ones get other names if the documents have them.
    """
    gone = removed_lines(documents, percent, least, id_column, text_column).groupBy("doc").agg(
        F.sort_array(F.collect_set("line")).alias("removed"), F.sort_array(F.collect_set("to_doc")).alias("similar"))
    doc, removed, similar, n_removed, n_similar = fresh(documents, "doc", "removed", "similar", "removed_lines", "similar_docs")
    gone = gone.toDF(doc, removed, similar)
    joined = documents.join(gone, quoted(id_column).cast("long") == F.col(doc), "left")
    text = quoted(text_column)
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col(removed), i))
    changed = F.when(F.col(removed).isNotNull(), F.array_join(kept, "\n")).otherwise(text)
    return joined.withColumn(text_column, changed).withColumn(n_removed, F.coalesce(removed, F.array().cast("array<int>"))).withColumn(
        n_similar, F.coalesce(similar, F.array().cast("array<bigint>"))).select(*[quoted(c) for c in documents.columns], n_removed, n_similar)


def report(documents: DataFrame, percent: int = PERCENT, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's id, ``n_lines``, ``n_removed``, ``removed_lines`` and ``similar_docs``; moves no text."""
    narrow = documents.select(F.col(id_column), F.size(F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    gone = removed_lines(documents, percent, least, id_column, text_column).groupBy("doc").agg(
        F.sort_array(F.collect_set("line")).alias("removed_lines"), F.sort_array(F.collect_set("to_doc")).alias("similar_docs"))
    return narrow.join(gone, F.col(id_column) == F.col("doc"), "left").select(
        id_column, "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce("similar_docs", F.array().cast("array<bigint>")).alias("similar_docs"))
