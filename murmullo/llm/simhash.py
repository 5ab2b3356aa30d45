"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint has 64 bits, each the majority of the hashes of a text's shingles. Documents with equal
fingerprints are one entry. Entries are ordered by the rank of their fingerprint in the Gray sequence,
where neighbours differ in few bits, and cut into cells by their top bits and then into blocks of bounded
size. A block carries a tree: a node stands for a run of entries and holds the bits that they all share
and that its parent doesn't hold already. A search adds up the differences on the way down and leaves a
node, with all below it, as soon as the sum exceeds the radius; it also leaves a node whose entries are
all in the searcher's component already, so dense groups aren't compared pair by pair.

A fingerprint can only be within the radius of one whose cell differs in at most that many bits, so pairs
of blocks are made by an equality join on the cells a flip away. Each pair is one group of at most two
blocks and returns at most one link per entry. Components of the links are found by joins.

Defined cases: a null or blank text has fingerprint 0 and is linked like any other; a row without id
links with nothing and has no component; repeated rows share their component; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from murmullo.llm.graph import components
from murmullo.session import materialize

SHINGLE = 4
RADIUS = 4
BLOCK = 16_384  # entries
FAN = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SIGN = np.uint64(1 << 63)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of a text as an unsigned integer; 0 without words."""
    line = b" ".join((text or "").encode().translate(_LOWER).split())
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(line)]))
    digest = xxhash.xxh64_intdigest
    if len(starts) <= size:
        return digest(line, 42)
    # counts of each bit, over runs of shingles so that long texts take bounded memory
    total = np.zeros(64, np.int64)
    n = len(starts) - size + 1
    for at in range(0, n, 1 << 16):
        spans = zip(starts[at:min(at + (1 << 16), n)].tolist(), ends[at + size - 1:at + size - 1 + (1 << 16)].tolist())
        hashes = np.array([digest(line[a:b], 42) for a, b in spans], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])

    return documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, fp long")


def gray_rank(fp):
    """Place of a fingerprint in the Gray sequence, as a long that sorts like the unsigned place."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-1 << 63))


class GrayTree:
    """Levels of nodes over entries in Gray order, the finest first; a node is FAN nodes of the level below."""

    def __init__(self, fps: np.ndarray):
        ones, some, self.patterns, self.residuals, shared = fps, fps, [], [], []
        while True:
            cuts = np.arange(0, len(ones), FAN)
            ones, some = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(some, cuts)
            self.patterns.append(ones)
            shared.append(~(ones ^ some))
            if len(ones) == 1:
                break
        for level, own in enumerate(shared):
            above = shared[level + 1][np.arange(len(own)) // FAN] if level + 1 < len(shared) else np.uint64(0)
            self.residuals.append(own & ~above)
        self.fps = fps
        self.spans = [FAN ** (level + 1) for level in range(len(shared))]

    def uniform(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and largest label below each node."""
        found, low, high = [], labels, labels
        for _ in self.spans:
            cuts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            found.append((low, high))
        return found

    def search(self, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs within the radius, but for entries whose node carries the query's label throughout."""
        known = self.uniform(labels)
        q = np.arange(len(queries))
        node, total = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for level in range(len(self.spans) - 1, -1, -1):
            total = total + np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.residuals[level][node])
            low, high = known[level]
            open_ = (total <= radius) & ~((low[node] == high[node]) & (low[node] == own[q]))
            q, node, total = q[open_], node[open_], total[open_]
            below = (node[:, None] * FAN + np.arange(FAN)).ravel()
            size = len(self.patterns[level - 1]) if level else len(self.fps)
            q, total = np.repeat(q, FAN), np.repeat(total, FAN)
            inside = below < size
            q, node, total = q[inside], below[inside], total[inside]
        near = np.bitwise_count(queries[q] ^ self.fps[node]) <= radius
        return q[near], node[near]


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        parent[x] = parent[up]
        x = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i] for all i; a root is the smallest of its set."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        open_ = a != b
        a, b = np.minimum(a[open_], b[open_]), np.maximum(a[open_], b[open_])
        np.minimum.at(parent, b, a)


def link_blocks(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, step: int = 512) -> np.ndarray:
    """For entries of one or two blocks in Gray order, left first, the smallest entry of their component."""
    fps = left if right is None else np.concatenate((left, right))
    tree, at = GrayTree(left if right is None else right), 0 if right is None else len(left)
    parent = np.arange(len(fps))
    for start in range(0, len(left), step):
        labels = _roots(parent, np.arange(len(fps)))
        own = labels[start:start + step]
        q, entry = tree.search(left[start:start + step], labels[at:], own, radius)
        unite(parent, q + start, entry + at)
    return _roots(parent, np.arange(len(fps)))


def _blocks(entries: DataFrame, bits: int, parts: int) -> DataFrame:
    """Blocks of entries of one cell in Gray order: cell, block (its first fingerprint), shared bits, entries."""
    schema = "cell long, block long, pattern long, mask long, fps binary, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(fps, ids):
            u = fps.view(np.uint64)
            ones, some = np.bitwise_and.reduce(u), np.bitwise_or.reduce(u)
            cell = int(u[0] >> np.uint64(64 - bits)) if bits else 0
            return cell, int(fps[0]), int(ones.astype(np.int64)), int((~(ones ^ some)).astype(np.int64)), fps.tobytes(), ids.tobytes()

        def out(rows):
            kinds = [pa.int64()] * 4 + [pa.binary()] * 2
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["cell", "block", "pattern", "mask", "fps", "ids"])

        held = [np.empty(0, np.int64)] * 2
        for batch in batches:
            held = [np.concatenate((h, batch.column(c).to_numpy(zero_copy_only=False))) for h, c in zip(held, ("fp", "id"))]
            cells = held[0].view(np.uint64) >> np.uint64(64 - bits) if bits else np.zeros(len(held[0]), np.uint64)
            ends = np.concatenate((np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]))
            rows, at = [], 0
            for end in ends.tolist():
                while end - at >= BLOCK or (end < len(cells) and end > at):
                    stop = min(at + BLOCK, end)
                    rows.append(row(held[0][at:stop].copy(), held[1][at:stop].copy()))
                    at = stop
            held = [h[at:] for h in held]
            if rows:
                yield out(rows)
        if len(held[0]):
            yield out([row(held[0], held[1])])

    ordered = entries.withColumn("gray", gray_rank(F.col("fp"))).repartitionByRange(parts, "gray").sortWithinPartitions("gray")
    return ordered.select("fp", "id").mapInArrow(run, schema)


def linked(entries: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of ids that give the components of ``entries`` (fp, id), n of them with distinct fingerprints."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / BLOCK)))
    parts = 2 ** min(bits, 12) + 1
    blocks = materialize(_blocks(entries, bits, parts), "gray-blocks")
    flips = [sum(1 << b for b in x) for k in range(min(radius, bits) + 1) for x in itertools.combinations(range(bits), k)]
    head = blocks.select("cell", "block", "pattern", "mask")
    left = head.select(F.col("block").alias("a"), F.col("pattern").alias("pa"), F.col("mask").alias("ma"), "cell")
    left = left.withColumn("flip", F.explode(F.lit(flips))).withColumn("cell", F.col("cell").bitwiseXOR(F.col("flip")))
    right = head.select(F.col("block").alias("b"), F.col("pattern").alias("pb"), F.col("mask").alias("mb"), "cell")
    pairs = left.join(right, "cell").where("a <= b and bit_count((pa ^ pb) & ma & mb) <= %d" % radius).select("a", "b")
    sides = pairs.withColumn("block", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))))
    loaded = sides.join(blocks.select("block", "fps", "ids"), "block")

    def link(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["block", "fps", "ids"]).to_pylist(), key=lambda r: r["block"])
        fps = [np.frombuffer(r["fps"], np.uint64) for r in rows]
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        root = link_blocks(fps[0], fps[1] if len(fps) > 1 else None, radius)
        hung = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": ids[hung], "b": ids[root[hung]]})

    return loaded.groupBy("a", "b").applyInArrow(link, "a long, b long")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """Every document's id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the smallest id of its group."""
    prints = materialize(fingerprints(documents, id_column, text_column), "fingerprints")
    entries = materialize(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")), "entries")
    found = components(linked(entries, entries.count(), radius))
    group = entries.join(found, entries["id"] == found["node"], "left").select(
        F.col("fp"), F.coalesce("component", "id").alias("component_id"))
    group = materialize(group, "groups")
    return prints.join(group, "fp", "left").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
