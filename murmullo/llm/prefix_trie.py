"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

Every turn is a 16-byte digest of its role and text, a conversation the path of its turns. Equal conversations are counted first. The
distinct paths are range-partitioned and sorted. Two neighbours with a common prefix of length l are joined by an
edge of depth l; in a block of neighbours the edges are taken in descending depth, and the first merge of two components at a
depth makes the branching node there. Between its merges a component is a chain of nodes with the same members,
so all nodes come out closed, with their final figures, as soon as the next merge lies above them.

Only nodes on the paths of a block's first and last conversation can have members in other blocks. They stay open: a block is contracted
to these two paths (spines), each with what its closed parts add at every depth. Spines are sorted
paths again and are merged by the same rule, block by block, until one block holds all. A block has at most ``BLOCK`` paths, so a
round leaves some 2 of 16,384 of them. Smallest members then flow back from the last round to the first, for the
children of nodes that were open; those joins are keyed by spine, which bounds their groups. Every round is written to the shared folder.

A conversation (its digests, 16 bytes a turn) is one row, as a text is; copies of a conversation, and
conversations that start alike, may be any share of all rows: copies are counted map-side, and the list of their
ids is hashed from pieces that are sorted and joined in ranges of ids before they meet.

Defined cases: rows without conv_id belong to no conversation; a null role or text is the empty one; turns of one number are ordered by their
digest; repeated rows are turns each; an empty table has no nodes, not even a root; a conversation left without turns is a member of the root.
Columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from murmullo.llm.common import words
from murmullo.session import materialize

FAMILY, HEADS = 20, 4  # conversations that share a base; a rebuilt one takes fewer than HEADS turns of it
BLOCK = 16_384  # paths merged at once
MOST_TURNS = 2_000_000  # turns merged at once, if they are of more than four paths
PIECE = 4_096  # ids in a piece of a list that is hashed

_ITEM = "struct<depth:int,n:bigint,low:bigint,kids:bigint,leaves:bigint,saved:bigint,ends:string>"
_SPINE = f"sid bigint, path array<binary>, words array<int>, items array<{_ITEM}>"
_TABLE = (
    "kind string, conv_id bigint, depth bigint, parent bigint, parent_sid bigint, parent_depth int, n bigint, kids bigint, leaves bigint, saved bigint, ends string, "
    f"{_SPINE}, up bigint, upto int, lows array<bigint>"
)
_ARROW_ITEM = pa.struct([("depth", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
_ARROW = pa.schema([
    ("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("parent_sid", pa.int64()), ("parent_depth", pa.int32()),
    ("n", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
    ("sid", pa.int64()), ("path", pa.list_(pa.binary())), ("words", pa.list_(pa.int32())), ("items", pa.list_(_ARROW_ITEM)),
    ("up", pa.int64()), ("upto", pa.int32()), ("lows", pa.list_(pa.int64())),
])


# --- conversations as paths ---


def rebuild(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Rebuilt conversations: ``member``, ``path`` (digests of turns) and ``words`` (of each turn).

    A conversation c takes the first h turns of conversation c - c % family, then its own turns after its first
    h; h is the CRC-32 of its decimal id modulo heads.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    member = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        member.alias("member"), (member - member % family).alias("base"),
        F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.size(words(text)).alias("words")).alias("t"))
    # one shuffle: the families stay together for the window
    own = turns.repartition("base").groupBy("base", "member").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.first(F.when(F.col("member") == F.col("base"), F.slice("own", 1, heads - 1)), ignorenulls=True).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("member").cast("string").cast("binary")) % heads).cast("int")
    joined = own.select("member", "own", F.coalesce(head, F.slice("own", 1, 0)).alias("head"), h.alias("h"))
    all_turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return joined.select("member", all_turns.alias("t")).select(
        "member", F.transform("t", lambda x: x["digest"]).alias("path"), F.transform("t", lambda x: x["words"]).alias("words"))


def _list_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending members of every ``seq``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for batch in batches:
            out = []
            for seq, member in zip(batch.column("seq").to_pylist(), batch.column("member").to_pylist()):
                if ids and (seq != now or len(ids) >= PIECE):
                    out.append((now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = seq
                ids.append(member)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["seq", "least", "ids"])
        if ids:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([now], pa.binary()), "least": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
                if state is not None and seq == now:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = seq, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], ["seq", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([now], pa.binary()), "ends": [state.hexdigest()]})

    ranged = members.repartitionByRange("member").sortWithinPartitions("seq", "member").mapInArrow(pieces, "seq binary, least long, ids string")
    return ranged.repartition("seq").sortWithinPartitions("seq", "least").mapInArrow(hashes, "seq binary, ends string")


# --- one block ---


class _Node:
    """What is known of an open node: members, smallest member, closed children with their leaves and savings."""

    __slots__ = ("n", "low", "kids", "leaves", "saved", "ends", "children")

    def __init__(self, item: dict | None = None):
        i = item or {}
        self.n, self.low, self.ends, self.children = i.get("n", 0), i.get("low"), i.get("ends"), []
        self.kids, self.leaves, self.saved = i.get("kids", 0), i.get("leaves", 0), i.get("saved", 0)

    def add(self, other: "_Node") -> None:
        self.n, self.kids, self.leaves, self.saved = self.n + other.n, self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        if other.low is not None and (self.low is None or other.low < self.low):
            self.low = other.low
        self.ends = other.ends if self.ends is None else self.ends
        if len(self.children) < len(other.children):
            self.children, other.children = other.children, self.children
        self.children += other.children


def common_prefix(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Forest:
    """Merges sorted paths; ``nodes`` are closed, ``spines`` open, ``links`` say where a path's nodes have gone."""

    def __init__(self, paths: list[list[bytes]], words: list[list[int]], items: list[list[dict]], sid: int, final: bool):
        m = len(paths)
        self.paths, self.words, self.last, self.final, self.sid = paths, words, m - 1, final, sid
        self.root, self.first_of, self.last_of = list(range(m)), list(range(m)), list(range(m))
        self.depth = [len(p) for p in paths]
        self.waiting = [{i["depth"]: _Node(i) for i in its} for its in items]  # by depth, below the top of a component
        self.top = [w.pop(d, None) or _Node() for w, d in zip(self.waiting, self.depth)]
        self.nodes: list[list] = []
        self.extents: list[tuple[int, int, int, int]] = []
        self.open: tuple[list[dict], list[dict]] = ([], [])
        self.lcp = [common_prefix(a, b) for a, b in zip(paths, paths[1:])]
        for i in sorted(range(m - 1), key=lambda i: -self.lcp[i]):
            a, b = self._find(i), self._find(i + 1)
            self._lift(a, self.lcp[i])
            self._lift(b, self.lcp[i])
            self._join(a, b)
        self._lift(self._find(0), -1)

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def _join(self, a: int, b: int) -> None:
        """Two components whose tops are the same node."""
        if self.last_of[a] - self.first_of[a] < self.last_of[b] - self.first_of[b]:
            a, b = b, a
        self.root[b] = a
        self.first_of[a], self.last_of[a] = min(self.first_of[a], self.first_of[b]), max(self.last_of[a], self.last_of[b])
        self.top[a].add(self.top[b])
        small, large = sorted((self.waiting[a], self.waiting[b]), key=len)
        for d, node in small.items():
            if d in large:
                large[d].add(node)
            else:
                large[d] = node
        self.waiting[a], self.top[b], self.waiting[b] = large, None, None

    def _lift(self, c: int, target: int) -> None:
        """Finishes the nodes of a component below depth ``target``."""
        first, last = self.first_of[c], self.last_of[c]
        still_open = not self.final and (first == 0 or last == self.last)
        side = 0 if first == 0 else 1
        while self.depth[c] > target:
            d, node = self.depth[c], self.top[c]
            above = self.waiting[c].pop(d - 1, None) or _Node()
            if still_open:
                self.open[side].append({"depth": d, "n": node.n, "low": node.low, "kids": node.kids, "leaves": node.leaves, "saved": node.saved, "ends": node.ends})
                for child in node.children:
                    self.nodes[child][3:5] = self.sid + side, d
            else:
                leaves = node.leaves if node.kids else 1
                saved = node.saved + (node.n - 1) * self.words[first][d - 1] if d else node.saved
                for child in node.children:
                    self.nodes[child][2] = node.low
                above.n, above.kids, above.leaves, above.saved = above.n + node.n, above.kids + 1, above.leaves + leaves, above.saved + saved
                above.low = node.low if above.low is None else min(above.low, node.low)
                above.children.append(len(self.nodes))
                self.nodes.append([node.low, d, None, None, None, node.n, node.kids, leaves, saved, node.ends])
                self.extents.append((first, last, d, node.low))
            self.depth[c], self.top[c] = d - 1, above

    def spines(self) -> list[tuple]:
        """(sid, path, words, items) of the first and the last path."""
        if self.final:
            return []
        return [(self.sid + side, self.paths[i], self.words[i], self.open[side]) for side, i in enumerate(sorted({0, self.last}))]

    def links(self) -> list[tuple]:
        """(lows, up, upto) of every path: smallest members of its nodes; those up to depth ``upto`` are found on spine ``up``."""
        lows = [[None] * (len(p) + 1) for p in self.paths]
        for first, last, d, low in self.extents:
            for i in range(first, last + 1):
                lows[i][d] = low
        if self.final:
            return [(x, None, -1) for x in lows]
        to_first, to_last = [len(self.paths[0])], [len(self.paths[-1])]
        for x in self.lcp:
            to_first.append(min(to_first[-1], x))
        for x in reversed(self.lcp):
            to_last.append(min(to_last[-1], x))
        to_last.reverse()
        return [(x, self.sid, a) if a >= b else (x, self.sid + 1, b) for x, a, b in zip(lows, to_first, to_last)]


def _merged(spines: DataFrame, final: bool, first_round: bool, block: int, most_turns: int) -> DataFrame:
    """Nodes, spines and links of all blocks of sorted spines."""

    def rows(forest: Forest, sids: list[int]) -> pa.RecordBatch:
        columns: dict[str, list] = {f.name: [] for f in _ARROW}
        kinds = [("node", n) for n in forest.nodes] + [("spine", s) for s in forest.spines()]
        if not first_round:
            kinds += [("link", (sid, *x)) for sid, x in zip(sids, forest.links())]
        names = {
            "node": ("conv_id", "depth", "parent", "parent_sid", "parent_depth", "n", "kids", "leaves", "saved", "ends"),
            "spine": ("sid", "path", "words", "items"), "link": ("sid", "lows", "up", "upto"),
        }
        for kind, row in kinds:
            said = dict(zip(names[kind], row), kind=kind)
            for name, values in columns.items():
                values.append(said.get(name))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _ARROW], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid = TaskContext.get().partitionId() << 32
        held: tuple[list, list, list, list] = ([], [], [], [])
        turns = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("sid", "path", "words", "items"))):
                if not final and len(held[0]) >= 4 and (len(held[0]) >= block or turns >= most_turns):
                    yield rows(Forest(*held[1:], sid, final), held[0])
                    held, turns, sid = ([], [], [], []), 0, sid + 2
                for values, value in zip(held, row):
                    values.append(value)
                turns += len(row[1])
        if held[0]:
            yield rows(Forest(*held[1:], sid, final), held[0])

    return spines.mapInArrow(run, _TABLE)


# --- all blocks ---


def build_trie(sequences: DataFrame, block: int = BLOCK, most_turns: int = MOST_TURNS) -> DataFrame:
    """Nodes of the trie of ``sequences`` (member, path, words): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    named = materialize(sequences.select("member", F.unhex(F.sha2(F.array_join(F.transform("path", lambda x: F.hex(x)), ""), 256)).alias("seq"), "path", "words"), "paths")
    distinct = named.groupBy("seq", "path", "words").agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("low"))
    counted = distinct.join(_list_digests(named.select("seq", "member")), "seq")
    item = F.struct(F.size("path").alias("depth"), "n", "low", F.lit(0).cast("long").alias("kids"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "ends")
    spines = counted.select(F.lit(0).cast("long").alias("sid"), "path", "words", F.array(item).alias("items"))
    spines = spines.repartitionByRange("path").sortWithinPartitions("path")
    rounds, final, before = [], False, None
    while True:
        rounds.append(materialize(_merged(spines, final, not rounds, block, most_turns), "trie"))
        if final:
            break
        left = rounds[-1].where("kind = 'spine'").select("sid", "path", "words", "items")
        count, turns = left.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("path")), F.lit(0))).first()
        final = count <= 4 or (count <= block and turns <= most_turns) or (before is not None and count >= before)
        before = count
        if final:
            spines = left.coalesce(1).sortWithinPartitions("sid")
        else:
            parts = min(max(math.ceil(count / block), math.ceil(turns / most_turns)), max(1, count // 4))
            spines = left.repartitionByRange(parts, "sid").sortWithinPartitions("sid")
    # smallest members flow back, from the last round to the first
    known, found = None, []
    for k in reversed(range(len(rounds))):
        nodes = rounds[k].where("kind = 'node'").select("conv_id", "depth", "parent", "parent_sid", "parent_depth", "n", "kids", "leaves", "saved", "ends")
        found.append(nodes.where("parent_sid is null"))
        if known is not None:
            waiting = nodes.where("parent_sid is not null").join(known.withColumnRenamed("sid", "parent_sid"), "parent_sid")
            found.append(waiting.withColumn("parent", F.get("lows", F.col("parent_depth"))).select(nodes.columns))
        if k:
            links = rounds[k].where("kind = 'link'").select("sid", "up", "upto", "lows")
            if known is not None:
                above = known.select(F.col("sid").alias("up"), F.col("lows").alias("above"))
                links = links.join(above, "up").withColumn("lows", F.transform("lows", lambda x, i: F.when(i <= F.col("upto"), F.get("above", i)).otherwise(x)))
            known = links.select("sid", "lows")
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations (conv_id, turn, role, text)."""
    return build_trie(rebuild(conversations, family, heads), block)
