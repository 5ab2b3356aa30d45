"""Mixing sources to target weights by hierarchical budgets.

The leaves of a domain - language - source tree hold documents. A token budget enters at the root and is
split among children by weight. A child cannot use more than its capacity (its tokens times the number of
epochs allowed); what it leaves is split again among its siblings by weight, and only what a whole family
cannot use goes back to the level above. Every leaf then takes whole epochs and a prefix, by tokens, of
one more epoch in that epoch's seeded order. DataFrame operations only.

The split among siblings is a closed form, not a loop: with capacities c and weights w, child i gets
min(c_i, L w_i), and L follows from prefix sums over the siblings ordered by c/w. The prefix within a leaf
needs no sort of a leaf in one task: documents lie in bins by hash, an epoch is a seeded order of bins
and a seeded order inside each bin, and bins add up in a small table first.

Defined cases: a null domain, language or source is the group ``""`` of its own; a null or empty text has
no tokens and is never taken; a weight that is missing is 1; a weight of 0 or less takes nothing; repeated
rows are each a row (ties are ordered by doc_id and then by a hash of the text); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from murmullo.llm.common import SPACE, quoted

LEVELS = ("domain", "lang", "source")
BIN_DIGITS = 3  # 16^3 bins in a leaf


def token_count(text: Column) -> Column:
    """Number of words of a text."""
    words = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.size(F.array_remove(words, "")).cast("long")


def source_domain(source: Column) -> Column:
    """Domain of a source: its number modulo 4, as ``d0`` to ``d3``; ``d`` without a number."""
    return F.concat(F.lit("d"), F.coalesce((F.regexp_extract(source, r"(\d+)", 1).try_cast("long") % 4).cast("string"), F.lit("")))


def _weight(weights: dict[str, float], key: Column) -> Column:
    if not weights:
        return F.lit(1.0)
    pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(1.0))


def _split(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budget of each child from ``budget`` of its parent (on the same row), ``weight`` and ``capacity``."""
    family = Window.partitionBy(*parent)
    order = family.orderBy("ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        nodes.withColumn("share", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
        .withColumn("room", F.when(F.col("share") > 0, F.col("capacity")).otherwise(F.lit(0)))
        .withColumn("ratio", F.when(F.col("share") > 0, F.col("room") / F.col("share")).otherwise(0.0))
        .withColumn("full", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("rest", F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.when(F.col("rest") > 0, (F.col("budget") - F.col("full")) / F.col("rest")))
        # the first child in this order whose own level it can bear sets the level of all
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", name, "level"))).over(family)["level"])
        .withColumn("budget", F.when(F.col("level").isNull(), F.col("room").cast("double"))
                    .otherwise(F.least(F.col("room").cast("double"), F.col("level") * F.col("share"))))
        .drop("share", "room", "ratio", "full", "rest", "level")
    )


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], share: float, epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the column ``budget``; ``share`` of all tokens is given out."""
    # a leaf below a weight of 0 takes nothing, so it is no capacity of the nodes above it either
    usable = F.lit(True)
    for level in LEVELS:
        usable = usable & (_weight(weights.get(level, {}), F.col(level)) > 0)
    leaves = leaves.withColumn("capacity", F.when(usable, F.col("tokens") * epochs).otherwise(F.lit(0).cast("long")))
    grand = leaves.agg(F.sum("tokens").alias("all"))
    at = (
        leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
        .withColumn("budget", grand.scalar().cast("double") * F.lit(float(share)))
        .withColumn("root", F.lit(0))
        .withColumn("weight", _weight(weights.get("domain", {}), F.col("domain")))
    )
    at = _split(at, ["root"], "domain").select("domain", F.col("budget"))
    for depth in (2, 3):
        keys, parent = list(LEVELS[:depth]), list(LEVELS[:depth - 1])
        name = keys[-1]
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.join(at, parent).withColumn("weight", _weight(weights.get(name, {}), F.col(name)))
        at = _split(nodes, parent, name).select(*keys, "budget", *(["tokens"] if depth == 3 else []))
    return at


def select_mix(
    documents: DataFrame,
    weights: dict[str, dict[str, float]] | None = None,
    share: float = 1.0,
    epochs: int = 2,
    seed: int = 7,
    domain: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Documents taken, one row for each, with ``copies`` and their leaf.

    weights: by level (domain, lang, source) and name; share: token budget as a share of the tokens the
    documents have; epochs: how often a leaf may be read at most; keep: columns of the documents to
    carry along (doc_id only unless given). Added columns: domain, lang, source, n_tokens, leaf_budget,
    copies (times taken) and last_epoch (taken in the last, partial epoch).
    """
    keep = ["doc_id"] if keep is None else keep
    carried, inner = {c: f"kept_{i}" for i, c in enumerate(keep)}, []
    domain = source_domain(F.col("source")) if domain is None else domain
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = documents.select(
        F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        token_count(F.col("text")).alias("n_tokens"), F.col("doc_id").alias("row_id"), F.substring(key, 1, BIN_DIGITS).alias("bin"),
        F.xxhash64("text").alias("row_tie"), *[quoted(c).alias(v) for c, v in carried.items()],
    )
    keys = list(LEVELS)
    bins = rows.groupBy(*keys, "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    leaf = budgets(bins.groupBy(*keys).agg(F.sum("bin_tokens").alias("tokens")), weights or {}, share, epochs)
    # whole epochs, and what is left for one more
    leaf = leaf.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("long"))
    leaf = leaf.withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens"))
    epoch_key = lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), c))
    plan = (
        bins.join(leaf, keys).withColumn("bin_key", epoch_key(F.col("bin")))
        .withColumn("start", F.coalesce(F.sum("bin_tokens").over(
            Window.partitionBy(*keys).orderBy("bin_key", "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*keys, "bin", "whole", "left", "start", F.col("budget").alias("leaf_budget"))
    )
    in_bin = Window.partitionBy(*keys, "bin").orderBy("row_key", "row_id", "row_tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        rows.join(plan, [*keys, "bin"])
        .withColumn("row_key", epoch_key(F.coalesce(F.col("row_id").cast("string"), F.lit(""))))
        .withColumn("before", F.col("start") + F.coalesce(F.sum("n_tokens").over(in_bin), F.lit(0)))
        .withColumn("last_epoch", (F.col("n_tokens") > 0) & (F.col("before") < F.col("left")))
        .withColumn("copies", F.when(F.col("n_tokens") > 0, F.col("whole")).otherwise(F.lit(0)) + F.col("last_epoch").cast("long"))
        .where("copies > 0")
    )
    added = [*keys, "n_tokens", "leaf_budget", "copies", "last_epoch"]
    out = [F.col(v).alias(c) for c, v in carried.items()]
    return taken.select(*out, *[F.col(c) for c in added if c.lower() not in {k.lower() for k in keep}])
