"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features describe the line and its two neighbours; the
chain adds weights for neighbouring labels. Forward-backward gives each line's chance of being good, and
their mean, weighted by line length and passed through a fitted logistic curve, is the document's score.

Training uses a bounded sample: at most ``most_docs`` labelled documents of either class, the first in
hash order, outside the held-out fifth. Labels say only whether a document is good, so its lines inherit
its label. The sample is dealt to ``folds`` groups by hash; each fits the field and the curve by Adam,
and the parameters are averaged (parameter mixing), weighted evenly. Scoring moves no row.

Defined cases: a null, empty or blank text is one empty line and is scored like any other; a null id is
scored but never trained on; rows with a null quality are not labels; repeated rows are scored each; if
one class has no sample, all scores are the share of the other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.3
RUN_BYTES = 4 << 20
STEPS, RATE, DECAY = 150, 0.08, 1e-4

_KIND = np.zeros((256, 6), np.float32)  # upper, digit, symbol, bar, shout, beyond ASCII
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
_KIND[[ord(c) for c in "#*$%&<>@{}[]=_~^\\/"], 2] = 1
_KIND[ord("|"), 3] = 1
_KIND[[ord(c) for c in "!?"], 4] = 1
_KIND[128:, 5] = 1
OWN = 15  # features of a line itself
FEATURES = 3 * OWN + 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _runs(texts: list[str | None]) -> Iterator[list[bytes]]:
    run, size = [], 0
    for t in texts:
        raw = (t or "").encode()
        if run and size + len(raw) > RUN_BYTES:
            yield run
            run, size = [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield run


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    more, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    more[order[1:][same]] = more[order[:-1][same]] = True
    later[order[1:][same]] = True
    return more, later


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines with a word, lengths in bytes, number of lines of each text); a text without words is one empty line."""
    lines = [[x for x in t.split(b"\n") if x.strip(b" \t\n\x0b\f\r")] or [b""] for t in texts]
    counts = np.array([len(x) for x in lines], np.int64)
    flat = [x for group in lines for x in group]
    n = len(flat)
    size = np.fromiter(map(len, flat), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), counts)
    words = [x.split() for x in flat]
    n_words = np.fromiter(map(len, words), np.int64, n)
    raw = np.frombuffer(b"".join(flat), np.uint8)
    kinds = np.zeros((n, 6))
    if len(raw):
        filled = np.flatnonzero(size)
        starts = (np.cumsum(size) - size)[filled]
        for k in range(6):
            kinds[filled, k] = np.add.reduceat(_KIND[raw, k], starts)
    kinds /= np.maximum(size, 1)[:, None]
    line_of = np.repeat(np.arange(n), n_words)
    codes = np.fromiter((hash(w) for group in words for w in group), np.int64, int(n_words.sum())).view(np.uint64)
    adjacent, covered, twice = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(codes) > 1:
        same = (codes[1:] == codes[:-1]) & (doc[line_of[1:]] == doc[line_of[:-1]])
        adjacent = np.bincount(line_of[1:][same], minlength=n) / np.maximum(n_words, 1)
    if len(codes) >= 5:
        window = doc[line_of].astype(np.uint64) * _MIX
        window = window[:-4]
        for k in range(5):
            window = (window ^ codes[k:len(codes) - 4 + k]) * _MIX
            window ^= window >> np.uint64(29)
        inside = doc[line_of[:-4]] == doc[line_of[4:]]
        more, _ = _repeated(np.where(inside, window, np.arange(len(window), dtype=np.uint64)))
        covered = np.bincount(line_of[:-4][more & inside], minlength=n) / np.maximum(n_words, 1)
    _, twice = _repeated(np.fromiter((hash((d, x)) for d, x in zip(doc.tolist(), flat)), np.int64, n))
    ends = np.array([x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in flat], float)
    mean = (size - n_words + 1) / np.maximum(n_words, 1)
    own = np.column_stack([
        np.sqrt(kinds), adjacent, covered, twice.astype(float), ends, np.log1p(n_words) / 4, np.minimum(mean, 40) / 10, (n_words == 0).astype(float),
        (n_words < 4).astype(float), np.minimum(np.abs(mean - 5.5), 20) / 10,
    ])
    first = np.cumsum(counts) - counts
    is_first, is_last = np.zeros(n), np.zeros(n)
    is_first[first], is_last[first + counts - 1] = 1, 1
    before = np.vstack([np.zeros((1, OWN)), own[:-1]]) * (1 - is_first)[:, None]
    after = np.vstack([own[1:], np.zeros((1, OWN))]) * (1 - is_last)[:, None]
    return np.column_stack([own, before, after, is_first, is_last, np.ones(n)]), np.maximum(size, 1), counts


class Chains:
    """Forward-backward over many chains at once; ``counts`` are their lengths, lines lie one after the other."""

    def __init__(self, counts: np.ndarray):
        starts = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        lengths, starts = counts[order], starts[order]
        active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(counts) else []
        self.steps = [starts[:k] + t for t, k in enumerate(active)]
        self.counts, self.order = counts, order

    def marginals(self, good: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of good for each line, chance of each pair of labels at each line and the one before).

        good: score of label 1 against label 0 of each line; trans[a, b]: score of b after a.
        """
        n = len(good)
        emit = np.column_stack([np.zeros(n), good])
        alpha, beta, pairs = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
        for t, at in enumerate(self.steps):
            if t:
                alpha[at] = np.logaddexp(alpha[at - 1][:, :1] + trans[0], alpha[at - 1][:, 1:] + trans[1])
            alpha[at] += emit[at]
            alpha[at] -= np.logaddexp(alpha[at][:, 0], alpha[at][:, 1])[:, None]
        for at in reversed(self.steps[1:]):
            ahead = emit[at] + beta[at]
            beta[at - 1] = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
            beta[at - 1] -= beta[at - 1].max(1)[:, None]
            joint = alpha[at - 1][:, :, None] + trans + ahead[:, None, :]
            joint = np.exp(joint - joint.max((1, 2))[:, None, None])
            pairs[at] = joint / joint.sum((1, 2))[:, None, None]
        both = alpha + beta
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), pairs


def document_means(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean chance of good of each document, weighted by line length."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)


def _curve(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def _adam(theta: np.ndarray, gradient, steps: int) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return theta


def fit(texts: list[str], quality: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the features, the four of label pairs, and slope and offset of the curve."""
    x, size, counts = line_features([(t or "").encode() for t in texts])
    chains = Chains(counts)
    label = np.repeat(quality, counts).astype(int)
    # every document counts by its class weight, whatever its number of lines; classes are balanced here
    balance = np.where(quality == 1, 0.5 / max((quality == 1).sum(), 1), 0.5 / max((quality == 0).sum(), 1))
    share = np.repeat(balance / counts, counts)
    first = np.zeros(len(label), bool)
    first[np.cumsum(counts) - counts] = True
    seen = np.zeros((len(label), 2, 2))
    inner = np.flatnonzero(~first)
    seen[inner, label[inner - 1], label[inner]] = 1

    def gradient(theta):
        good, pairs = chains.marginals(x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
        return np.concatenate([x.T @ (share * (good - label)), ((pairs - seen) * share[:, None, None]).sum(0).ravel()]) + DECAY * theta

    theta = _adam(np.zeros(FEATURES + 4), gradient, STEPS)
    good, _ = chains.marginals(x @ theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
    odds, w = _curve(document_means(good, size, counts)), weight / weight.sum()

    def slope(ab):
        off = w * (1 / (1 + np.exp(-np.clip(ab[0] * odds + ab[1], -500, 500))) - quality)
        return np.array([(off * odds).sum(), off.sum()])

    return np.concatenate([theta, _adam(np.array([1.0, 0.0]), slope, 300)])


def sample(labels: DataFrame, most_docs: int) -> DataFrame:
    """At most ``most_docs`` labelled ids of either class outside the held-out fifth, with the class weight."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("quality").cast("int").alias("sample_quality"))
    share = usable.agg(F.avg("sample_quality").alias("p"))
    parts = [usable.where(F.col("sample_quality") == k).orderBy(F.xxhash64("sample_id"), "sample_id").limit(most_docs) for k in (0, 1)]
    p = share.scalar()
    return parts[0].union(parts[1]).withColumn("sample_weight", F.when(F.col("sample_quality") == 1, p).otherwise(1 - p))


def train(documents: DataFrame, labels: DataFrame, most_docs: int = 3000, folds: int = 8) -> np.ndarray | float:
    """Parameters averaged over the folds; the share of good labels if only one class is there."""
    chosen = sample(labels, most_docs)
    # at most 2 * most_docs ids: their size is bounded by the parameter
    rows = documents.join(F.broadcast(chosen), F.col("doc_id") == F.col("sample_id"))
    rows = rows.select("doc_id", "text", "sample_quality", "sample_weight", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).alias("fold"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], na_position="first")
        quality = group["sample_quality"].to_numpy()
        theta = fit(group["text"].tolist(), quality, _per_class(quality, group["sample_weight"].to_numpy())).tolist() if 0 < quality.mean() < 1 else None
        return pd.DataFrame({"n": [len(group)], "good": [float(quality.sum())], "theta": [theta]})

    fitted = rows.groupBy("fold").applyInPandas(run, "n long, good double, theta array<double>").collect()  # a row for each fold
    found = [r["theta"] for r in sorted(fitted, key=lambda r: tuple(r["theta"] or ())) if r["theta"]]
    if found:
        return np.mean(found, axis=0)
    n = sum(r["n"] for r in fitted)
    return sum(r["good"] for r in fitted) / n if n else 0.5


def _per_class(quality: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights that give each class its share of all labels, however many of it are in the sample."""
    return share / np.where(quality == 1, max((quality == 1).sum(), 1), max((quality == 0).sum(), 1))


def score_texts(texts: list[str | None], theta: np.ndarray) -> np.ndarray:
    out = []
    for run in _runs(texts):
        x, size, counts = line_features(run)
        good, _ = Chains(counts).marginals(x @ theta[:FEATURES], theta[FEATURES:FEATURES + 4].reshape(2, 2))
        a, b = theta[FEATURES + 4:]
        out.append(1 / (1 + np.exp(-np.clip(a * _curve(document_means(good, size, counts)) + b, -500, 500))))
    return np.concatenate(out) if out else np.empty(0)


def score_quality(documents: DataFrame, labels: DataFrame, most_docs: int = 3000, folds: int = 8) -> DataFrame:
    """Every document's ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.3)."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    theta = train(narrow, labels.select("doc_id", "quality"), most_docs, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = score_texts(texts, theta) if isinstance(theta, np.ndarray) else np.full(len(texts), theta)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
