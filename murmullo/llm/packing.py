"""Packing of token ids into rows of equal length.

Texts become ids of a byte-level vocabulary, each text closed by an end id. A text longer than a row is
split into full rows and a rest; the place of a piece in its text is kept, so nothing is lost. Pieces of a
window (a bounded number of ids inside a task) are placed by best fit, longest first: a segment tree over
remaining capacities finds the fullest open row that still has room. Every row holds its ids, where each
segment ends, and positions that start anew with each segment. Windows need no shuffle and are packed
again from their input when an executor is lost.

Defined cases: a null text counts as empty; an empty text is its end id alone; a null id is kept as null
beside its piece; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut into pieces before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 50256
LENGTH = 2048
WINDOW_IDS = 4_000_000


class Encoder:
    """Ids of texts in the type that the vocabulary needs."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = "<u2" if len(ranks) < 1 << 16 else "<u4"

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(self.kind)


class CapacityTree:
    """Open rows by remaining capacity; an inner node tells whether some capacity below it has a row."""

    def __init__(self, most: int):
        self.half = 1 << most.bit_length()
        self.some = bytearray(2 * self.half)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _mark(self, capacity: int) -> None:
        node = self.half + capacity
        self.some[node] = bool(self.rows[capacity])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        if len(self.rows[capacity]) == 1:
            self._mark(capacity)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the smallest capacity that is at least ``need``; the row leaves the tree."""
        node = self.half + need
        if not self.some[node]:
            while node > 1 and not (node % 2 == 0 and self.some[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.half:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        capacity = node - self.half
        row = self.rows[capacity].pop()
        if not self.rows[capacity]:
            self._mark(capacity)
        return capacity, row


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers: longest first (ties in order), each into the fullest row with room."""
    tree, rows = CapacityTree(length), []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[piece])
        if found is None:
            found = length, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(piece)
        if capacity > lengths[piece]:
            tree.add(capacity - lengths[piece], row)
    return rows


PACKED = pa.schema([
    ("window", pa.string()), ("row", pa.int32()), ("n_ids", pa.int32()), ("input_ids", pa.binary()), ("position_ids", pa.binary()),
    ("cu_seqlens", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("ordinals", pa.list_(pa.int64())),
])
PACKED_COLUMNS = "window string, row int, n_ids int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>, ordinals array<long>"


def position_kind(length: int) -> str:
    """Type of the positions in rows of a length; that of the ids follows from the vocabulary."""
    return "<u2" if length <= 1 << 16 else "<u4"


def pack_window(pieces: list[tuple[int | None, int, np.ndarray, int]], name: str, length: int, end_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of the pieces (document, start, ids, number of the document in the window) of a window, as many at a time as make a batch."""
    held = []
    for number, row in enumerate(best_fit([len(p[2]) for p in pieces], length)):
        parts = [pieces[i] for i in row]
        sizes = [len(p[2]) for p in parts]
        n, ids, positions = sum(sizes), np.full(length, end_id, kind), np.zeros(length, position_kind(length))
        ids[:n] = np.concatenate([p[2] for p in parts])
        positions[:n] = np.concatenate([np.arange(s) for s in sizes])
        held.append({
            "window": name, "row": number, "n_ids": n, "input_ids": ids.tobytes(), "position_ids": positions.tobytes(),
            "cu_seqlens": np.cumsum([0, *sizes]).tolist(), "doc_ids": [p[0] for p in parts], "starts": [p[1] for p in parts], "ordinals": [p[3] for p in parts],
        })
        if len(held) == 512:
            yield pa.RecordBatch.from_pylist(held, schema=PACKED)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=PACKED)


def pack(documents: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID, window_ids: int = WINDOW_IDS,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packed rows: window and row, n_ids used, input_ids and position_ids (little-endian, ``length`` each, 2 bytes
    an id for vocabularies below 65,536 and a position in rows of up to 65,536 ids, else 4; unused places filled with ``end_id`` and 0),
    cu_seqlens, and for each segment its document, its start within the document's ids and the document's number within the window:
    window and number tell documents apart whose ids are null or repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = Encoder(vocabulary), TaskContext.get().partitionId(), 0
        pieces, held, ordinal = [], 0, 0
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = np.append(encoder.encode(text.as_py() or ""), np.array([end_id], encoder.kind))
                pieces += [(doc, at, ids[at:at + length], ordinal) for at in range(0, len(ids), length)]
                ordinal += 1
                held += len(ids)
                if held >= window_ids:
                    yield from pack_window(pieces, f"{part}-{number}", length, end_id, encoder.kind)
                    pieces, held, ordinal, number = [], 0, 0, number + 1
        if pieces:
            yield from pack_window(pieces, f"{part}-{number}", length, end_id, encoder.kind)

    return documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, PACKED_COLUMNS)


def write_matrices(packed: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Writes input_ids and position_ids of each task as id matrices (raw rows) below a shared folder.

    Returns a row per file pair: ``ids_path``, ``positions_path``, ``n_rows`` and the ``cu_seqlens`` of its rows, in order. Only
    files named in the result count: a lost attempt leaves files that nothing names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, cuts = TaskContext.get(), []
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        names = [f"{kind}-{task.partitionId():06d}-{task.taskAttemptId():08d}.bin" for kind in ("ids", "positions")]
        outs = [store.open_output_stream(f"{root}/{n}", compression=None) for n in names]
        for batch in batches:
            for column, out in zip(("input_ids", "position_ids"), outs):
                out.write(b"".join(batch.column(column).to_pylist()))
            cuts += batch.column("cu_seqlens").to_pylist()
        for out in outs:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{n}"]) for n in names] + [pa.array([len(cuts)], pa.int64()), pa.array([cuts], pa.list_(pa.list_(pa.int32())))],
            ["ids_path", "positions_path", "n_rows", "cu_seqlens"])

    return packed.mapInArrow(run, "ids_path string, positions_path string, n_rows long, cu_seqlens array<array<int>>")


def unpack(rows: list[dict], vocabulary: str = VOCABULARY) -> list[tuple[int | None, str]]:
    """Id and text of every document of packed rows, for checks on small tables."""
    encoder, parts = Encoder(vocabulary), {}
    for r in rows:
        ids = np.frombuffer(r["input_ids"], encoder.kind)
        for k, (doc, start, ordinal) in enumerate(zip(r["doc_ids"], r["starts"], r["ordinals"])):
            parts.setdefault((r["window"], ordinal, doc), []).append((start, ids[r["cu_seqlens"][k]:r["cu_seqlens"][k + 1]]))
    return [(k[2], encoder.encoding.decode(np.concatenate([p for _, p in sorted(x, key=lambda y: y[0])])[:-1].tolist())) for k, x in parts.items()]
