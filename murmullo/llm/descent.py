"""Embedding near-duplicates by NN-descent.

Equal vectors are one entry with a count. The neighbour graph starts from groups of entries on the same
side of random hyperplanes; a round then joins every entry's neighbours (both ways) with each other and
keeps the best found for each. A list whose neighbours all reach the threshold is saturated and is
doubled, up to ``MOST``. Rounds end when few neighbours change. Every pair at the threshold that any
round compares counts as a link, also one that finds no place in a list. Links give components; an entry
has a list of its own for entries outside its component, which neighbours inside can't fill, and rounds
start anew with the components found until they add no link. An audit searches a bounded sample of
entries, larger where links are rare, against all entries by brute force; if too many of its links are missing, lists are
doubled and rounds go on, and the third failure is an error. A sample without links is a warning. Inside each component all pairs of entries are compared in blocks, in double precision, so
the links of groups larger than any list are counted in full and only a link between two components can
be missed, if no round compares a pair of theirs.

Groups of any size are dealt by range of (group, hash of the entry), so a hub or a dense side of the
planes spans tasks, and are joined in runs of RUN members, in another order for each group and round. Navigation uses half precision, which is
exact to NEAR in cosine; edges closer to the threshold than that are computed anew in double precision.

Defined cases: a vector that is null, empty or zero or has null or non-finite components links with
nothing, nor does one without id, whose component is null and which is kept; vectors shorter than others
are filled up with zeros; repeated rows are each other's copies and count as links; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from murmullo.llm.graph import components
from murmullo.session import materialize

THRESHOLD = 0.95
NEAR = 2e-3
LIST, MOST = 12, 48  # neighbours kept, and kept at most when saturated
TABLES, GROUP = 6, 12  # sets of hyperplanes, and entries wanted on one side of them all
RUN = 48
ROUNDS, CHANGED = 8, 0.002
AUDIT, RECALL = 128, 0.97
AUDIT_MOST, AUDIT_LINKS = 2048, 32  # entries drawn at most, until so many links are among theirs
BLOCK = 1024
EDGE_COLUMNS = "u long, v long, sim float, kind int"
OWN, OUTSIDE, LINK = 0, 1, 2  # kinds of edges: of the list inside the component, of that outside, between components
SURE = 2.0  # similarity given to links that need no check


def _usable(vec_id: str, embedding: str):
    x = F.col(embedding)
    return (
        F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(x, lambda v: v != 0)
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column in double precision, filled with zeros up to ``width``."""
    out = np.zeros((len(column), width))
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _start(entries: DataFrame, width: int, n: int, seed: int) -> DataFrame:
    """side (group), id, half (unit vector in half precision) of each entry for each set of hyperplanes."""
    bits = min(40, max(1, round(math.log2(max(2, n / GROUP)))))
    planes = np.random.default_rng(seed).standard_normal((TABLES, width, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("embedding"), width))
            half = pa.array([x.tobytes() for x in unit.astype(np.float16)], pa.binary())
            for t in range(TABLES):
                side = ((unit @ planes[t] > 0) @ (1 << np.arange(bits, dtype=np.int64))) * TABLES + t
                yield pa.RecordBatch.from_arrays([pa.array(side), batch.column("id"), half], ["side", "id", "half"])

    return entries.select("id", "embedding").mapInArrow(run, "side long, id long, half binary")


def _links(ids, sim, comps, threshold: float):
    """Links between components in runs (runs, size, ...): members reached over sure links with the first of them, pairs that need a check."""
    size = sim.shape[1]
    same = comps[:, :, None] == comps[:, None, :]
    near = (sim >= threshold - NEAR) & ~same
    some = near.any((1, 2))
    ids, sim, comps, near = ids[some], sim[some], comps[some], near[some]
    met = same[some] | (sim >= threshold + NEAR)
    first = np.broadcast_to(np.arange(size), ids.shape)
    while True:
        least = np.where(met, first[:, None, :], size).min(2)
        if (least == first).all():
            break
        first = least
    root = np.take_along_axis(comps, first, 1)
    r, i = np.nonzero(root != comps)
    yield ids[r, first[r, i]], ids[r, i], np.full(len(r), SURE)
    r, i, k = np.nonzero(near & (first[:, :, None] < first[:, None, :]))
    yield ids[r, i], ids[r, k], sim[r, i, k]


def _joined(members: DataFrame, keep: int, threshold: float, turn: int) -> DataFrame:
    """Best pairs (u, v, sim) inside and outside the component of u within runs of members of a group, and all links between components.

    members: side (group), id, half, component, own and outside (similarities that pairs of u must exceed). turn: changes the runs.
    """

    def pairs(ids, half, comps, own, outside):
        """All runs of one size at once: arrays (runs, size, ...)."""
        x = half.astype(np.float32)
        sim = x @ x.transpose(0, 2, 1)
        for u, v, s in _links(ids, sim, comps, threshold):
            yield u, v, s, LINK
        same = comps[:, :, None] == comps[:, None, :]
        other = ids[:, :, None] != ids[:, None, :]
        for kind, floors, asked in ((OWN, own, same & other), (OUTSIDE, outside, ~same)):
            if not asked.any():
                continue
            some = np.where(asked & (sim > floors[:, :, None]), sim, np.float32(-2))
            if some.shape[2] > keep:
                best = np.argpartition(-some, keep - 1, axis=2)[:, :, :keep]
                values = np.take_along_axis(some, best, 2)
            else:
                best, values = np.broadcast_to(np.arange(some.shape[2]), some.shape), some
            r, i, k = np.nonzero(values > -2)
            yield ids[r, i], ids[r, best[r, i, k]], values[r, i, k], kind

    def out(side, ids, *columns):
        first = np.concatenate(([True], side[1:] != side[:-1]))
        within = np.arange(len(side)) - np.maximum.accumulate(np.where(first, np.arange(len(side)), 0))
        starts = np.flatnonzero(within % RUN == 0)
        sizes = np.diff(np.append(starts, len(side)))
        for size in np.unique(sizes[sizes > 1]).tolist():
            chosen = starts[sizes == size]
            step = max(1, 2_000_000 // (size * size))
            for at in range(0, len(chosen), step):
                index = chosen[at:at + step, None] + np.arange(size)
                for u, v, s, kind in pairs(ids[index], *(x[index] for x in columns)):
                    if len(u):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(u), pa.array(v), pa.array(s, pa.float32()), pa.array(np.full(len(u), kind, np.int32))], ["u", "v", "sim", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            half = np.frombuffer(b"".join(batch.column("half").to_pylist()), np.float16).reshape(batch.num_rows, -1)
            side, ids, *rest = (batch.column(c).to_numpy() for c in ("side", "id", "component", "own", "outside"))
            now = [side, ids, half, *rest]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last group may go on
            cut += (len(held[0]) - cut) // RUN * RUN
            yield from out(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from out(*held)

    mixed = members.withColumn("mixed", F.xxhash64("id", "side", F.lit(turn)))
    dealt = mixed.repartitionByRange("side", "mixed").sortWithinPartitions("side", "mixed")
    return dealt.select("side", "id", "half", "component", "own", "outside").mapInArrow(run, EDGE_COLUMNS)


def _best(graph: DataFrame | None, found: DataFrame, base: int, most: int) -> DataFrame:
    """The lists u, v, sim, kind, size (of the list), fresh: old ones with what a round has found, and all links."""
    found = found.select("u", "v", "sim", "kind", F.lit(None).cast("int").alias("size"), F.lit(1).alias("fresh"))
    every = found if graph is None else graph.select("u", "v", "sim", "kind", "size", F.lit(0).alias("fresh")).unionByName(found)
    every = every.groupBy("u", "v", "kind").agg(F.max("sim").alias("sim"), F.max("size").alias("size"), F.min("fresh").alias("fresh"))
    own = Window.partitionBy("u", "kind")
    every = every.withColumn("size", F.greatest(F.coalesce(F.max("size").over(own), F.lit(base)), F.lit(base)))
    every = every.withColumn("place", F.row_number().over(own.orderBy(F.desc("sim"), "v"))).where((F.col("kind") == LINK) | (F.col("place") <= F.col("size")))
    full = F.count(F.when(F.col("sim") >= THRESHOLD, 1)).over(own) >= F.col("size")
    return every.withColumn("size", F.when(full, F.least(2 * F.col("size"), F.lit(most))).otherwise(F.col("size"))).drop("place")


def _neighbours(graph: DataFrame, halves: DataFrame) -> DataFrame:
    """Members of the group of each entry: its neighbours and those that have it as a neighbour."""
    lists = graph.where(F.col("kind") != LINK)
    both = lists.select(F.col("u").alias("side"), F.col("v").alias("id")).union(lists.select("v", "u")).distinct()

    def floor(kind):
        size, sim = (F.when(F.col("kind") == kind, F.col(c)) for c in ("size", "sim"))
        return F.when(F.count(sim) >= F.max(size), F.min(sim)).otherwise(F.lit(-1.0)).cast("float")

    floors = lists.groupBy(F.col("u").alias("id")).agg(floor(OWN).alias("own"), floor(OUTSIDE).alias("outside"))
    floors = halves.join(floors, "id", "left").select("id", "half", "component", *[F.coalesce(c, F.lit(-1.0)).cast("float").alias(c) for c in ("own", "outside")])
    return both.join(materialize(floors, "halves"), "id")


def _labelled(table: DataFrame, group: DataFrame, node: str, component: str) -> DataFrame:
    """The table with the component of a node, which is the node itself if it has no links."""
    named = group.select(F.col("node").alias(node), F.col("component").alias(component))
    return table.join(named, node, "left").withColumn(component, F.coalesce(component, node))


def _sorted_out(graph: DataFrame, group: DataFrame) -> DataFrame:
    """The lists by the components that are known now; links are part of these."""
    lists = _labelled(_labelled(graph.where(F.col("kind") != LINK), group, "u", "cu"), group, "v", "cv")
    return lists.withColumn("kind", F.when(F.col("cu") == F.col("cv"), OWN).otherwise(OUTSIDE)).drop("cu", "cv")


def _certain(edges: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) at the threshold; those that half precision can't decide are computed in double precision."""
    edges = edges.where(F.col("sim") >= threshold - NEAR).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "sim")
    edges = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    close = edges.where(F.col("sim") < threshold + NEAR).select("a", "b")
    left, right = (entries.select(F.col("id").alias(x), F.col("embedding").alias("e" + x)) for x in "ab")
    double = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(double(x), double(y), lambda p, q: F.coalesce(p, F.lit(0.0)) * F.coalesce(q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("ea", "eb") / F.sqrt(dot("ea", "ea")) / F.sqrt(dot("eb", "eb"))
    verified = close.join(left, "a").join(right, "b").where(cosine >= threshold).select("a", "b")
    return edges.where(F.col("sim") >= threshold + NEAR).select("a", "b").union(verified)


def brute_force(entries: DataFrame, queries: list[tuple[int, list[float]]], width: int, threshold: float) -> DataFrame:
    """All (q, v) with a cosine at the threshold, of a bounded set of query vectors against every entry."""
    unit = np.zeros((len(queries), width))
    for k, (_, vector) in enumerate(queries):
        unit[k, :len(vector)] = vector
    unit, names = _unit(unit), np.array([q for q, _ in queries], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            v, q = np.nonzero(_unit(_matrix(batch.column("embedding"), width)) @ unit.T >= threshold)
            other = ids[v] != names[q]
            yield pa.RecordBatch.from_arrays([pa.array(names[q[other]]), pa.array(ids[v[other]])], ["q", "v"])

    return entries.select("id", "embedding").mapInArrow(run, "q long, v long")


def _counted(entries: DataFrame, found: DataFrame, width: int, threshold: float) -> DataFrame:
    """id and n: rows of other entries of its component that link with it directly."""
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_entries"))
    size = materialize(size, "sizes")
    rows = entries.join(found, entries["id"] == found["node"]).join(size, "component")
    rows = rows.withColumn("blocks", F.ceil(F.col("n_entries") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "copies", "embedding")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unit = _unit(_matrix(table.column("embedding").combine_chunks(), width))
        ids, own, copies = (table.column(c).to_numpy() for c in ("id", "own", "copies"))
        i = table.column("i")[0].as_py() if table.num_rows else 0
        a = np.flatnonzero(own == i)
        b = np.flatnonzero(own != i)
        if not len(b) and table.column("j")[0].as_py() == i:
            near = unit[a] @ unit[a].T >= threshold
            np.fill_diagonal(near, False)
            return pa.table({"id": ids[a], "n": near @ copies[a]})
        near = unit[a] @ unit[b].T >= threshold
        return pa.table({"id": np.concatenate((ids[a], ids[b])), "n": np.concatenate((near @ copies[b], near.T @ copies[a]))})

    return rows.groupBy("component", "i", "j").applyInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 3) -> DataFrame:
    """Every vector's id, ``n_links``, ``component_id`` (smallest id reachable) and ``kept`` (it is its component's smallest)."""
    spark = vectors.sparkSession
    plain = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("embedding"))
    usable = _usable("id", "embedding")
    entries = plain.where(usable).groupBy("embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    entries = materialize(entries, "entries")
    n, width = entries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    start = materialize(_start(entries, width, n, seed), "sides")
    drawn, base, most = AUDIT, LIST, MOST
    while True:
        queries = [(r["id"], r["embedding"]) for r in entries.orderBy(F.xxhash64("id"), "id").limit(drawn).select("id", "embedding").collect()]
        truth = materialize(brute_force(entries, queries, width, threshold), "truth")
        n_truth = truth.count()
        if n_truth >= AUDIT_LINKS or drawn >= min(n, AUDIT_MOST):
            break
        drawn = 4 * drawn
    if n and not n_truth:
        warnings.warn(f"no links among the {len(queries)} entries of the audit: its recall is not measured")
    graph, group, attempt, turn = None, None, 0, 0
    while True:
        known = spark.createDataFrame([], "node long, component long") if group is None else group
        lowest = F.lit(-1.0).cast("float")
        members = materialize(_labelled(start, known, "id", "component"), "members")
        found = _joined(members.withColumn("own", lowest).withColumn("outside", lowest), base, threshold, turn)
        graph = materialize(_best(None if graph is None else _sorted_out(graph, known), found, base, most), "graph")
        turn += 1
        halves = members.where(F.col("side") % TABLES == 0).select("id", "half", "component")
        for _ in range(0 if group is None else ROUNDS):
            found = _joined(_neighbours(graph, halves), base, threshold, turn)
            graph = materialize(_best(graph, found, base, most), "graph")
            turn += 1
            if graph.agg(F.coalesce(F.sum(F.when(F.col("kind") != LINK, F.col("fresh"))), F.lit(0))).first()[0] <= CHANGED * base * n:
                break
        links = materialize(_certain(graph.where(F.col("kind") == LINK), entries, threshold), "links")
        if group is None or not links.isEmpty():
            group = materialize(components(known.select(F.col("component").alias("a"), F.col("node").alias("b")).union(links)), "components")
            continue
        if not n_truth:
            break
        side = lambda x: group.select(F.col("node").alias(x), F.col("component").alias("c" + x))
        met = truth.join(side("q"), "q").join(side("v"), "v").where("cq = cv").count()
        attempt += 1
        if met >= RECALL * n_truth:
            break
        if attempt == 3:
            raise RuntimeError(f"the audit found {met} of {n_truth} links, less than a share of {RECALL}")
        base, most = 2 * base, 2 * most
    counted = materialize(_counted(entries, group, width, threshold), "counts")
    entry = entries.join(group, entries["id"] == group["node"], "left").join(counted, "id", "left").select(
        "embedding", F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    entry = materialize(entry, "groups")
    good = plain.where(usable).join(entry, "embedding").select("id", "n_links", "component_id")
    rest = plain.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = good.union(rest)
    return every.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
