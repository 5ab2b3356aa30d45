"""Fill-in-the-middle transformation with a learned index from token ranks to text offsets.

A text is cut into n tokens (blanks with the word after them, or the blanks at its end). The offsets of all n + 1
token borders are held as an index: straight pieces, fitted greedily so that every border lies within
``ERROR`` code points of its piece, and what is missing to the true offset, one byte a border. A cut at a rank is predicted
by its piece and set right by the stored residual, so it is exact. A text then becomes
prefix, middle and suffix between seeded ranks and is written in one of two orders:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

or stays plain. A text that holds a sentinel stays plain, so the parts of an output are its pieces between sentinels.

Everything happens inside tasks; no row moves.

Defined cases: a null or empty text has no tokens and stays plain (output: the empty text); a text of blanks is one
token; a null id is hashed as the empty string, so such texts share their draw; repeated rows are transformed alike;
an empty table gives an empty result; other columns are carried only if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from murmullo.llm.common import quoted

SEED = 42
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_RATE, SPM_RATE = 50, 80  # of 100
ERROR = 120  # code points; a residual, rounding included, fits one signed byte


@dataclass
class RankIndex:
    """Offsets by rank: pieces (first rank, offset there, slope) and a residual for every rank."""

    starts: np.ndarray
    bases: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, error: int = ERROR) -> "RankIndex":
        """Pieces start at a true offset and go on while some slope keeps all their ranks within the error."""
        starts, slopes, n, start = [], [], len(offsets), 0
        while start < n:
            low, high, at, width, end = -np.inf, np.inf, start + 1, 128, n
            while at < n:
                stop = min(at + width, n)
                run, rise = np.arange(at, stop) - start, offsets[at:stop] - offsets[start]
                lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
                highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
                crossed = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else -1
                if crossed >= 0:
                    if crossed:
                        low, high = lows[crossed - 1], highs[crossed - 1]
                    end = at + crossed
                    break
                low, high, at, width = lows[-1], highs[-1], stop, 2 * width
            starts.append(start)
            slopes.append((low + high) / 2 if end > start + 1 else 0.0)
            start = end
        starts, slopes = np.array(starts, np.int64), np.array(slopes, np.float64)
        index = cls(starts, offsets[starts].astype(np.int64), slopes, np.zeros(n, np.int8))
        index.residuals = (offsets - index.predict(np.arange(n))).astype(np.int8)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[piece] + np.rint(self.slopes[piece] * (ranks - self.starts[piece])).astype(np.int64)

    def offsets(self, ranks) -> np.ndarray:
        """Exact offsets of the borders with these ranks."""
        ranks = np.asarray(ranks, np.int64)
        return self.predict(ranks) + self.residuals[ranks]


def borders(text: str) -> np.ndarray:
    """Offsets of all token borders of a text, in code points, from 0 to its length."""
    if not text:
        return np.zeros(1, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.concatenate(([0], ends, [len(points)])).astype(np.int64)


def draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def split_text(doc_id: int | None, text: str, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE):
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    offsets = borders(text)
    n = len(offsets) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= fim_rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = RankIndex.fit(offsets).offsets(cuts).tolist()
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(documents: DataFrame, seed: int = SEED, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, keep: list[str] | None = None,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, n (tokens), form, prefix_chars, middle_chars (null if plain) and ``output`` of every document.

    fim_rate: documents of 100 that are transformed; spm_rate: those of 100 transformed that start with their suffix;
    keep: columns to carry along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [split_text(d.as_py(), t.as_py() or "", seed, fim_rate, spm_rate) for d, t in zip(batch.column("id"), batch.column("text"))]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *made, *[batch.column(c) for c in kept]], ["id", "n", "form", "prefix_chars", "middle_chars", "output", *kept])

    keep = keep or []
    kept = [f"kept_{i}" for i in range(len(keep))]
    narrow = documents.select(quoted(id_column).cast("long").alias("id"), quoted(text_column).alias("text"), *[quoted(c).alias(k) for c, k in zip(keep, kept)])
    kinds = "".join(f", {k} {narrow.schema[k].dataType.simpleString()}" for k in kept)
    out = narrow.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string" + kinds)
    return out.select(F.col("id").alias(id_column), "n", "form", "prefix_chars", "middle_chars", "output", *[F.col(k).alias(c) for c, k in zip(keep, kept)])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )


def rank_index(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", error: int = ERROR) -> DataFrame:
    """The index of every document: the id, n, starts, bases, slopes (one entry a piece) and residuals (one byte a border)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [RankIndex.fit(borders(t.as_py() or ""), error) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(x.residuals) - 1 for x in made], pa.int64()),
                pa.array([x.starts for x in made], pa.list_(pa.int64())), pa.array([x.bases for x in made], pa.list_(pa.int64())),
                pa.array([x.slopes for x in made], pa.list_(pa.float64())), pa.array([x.residuals.tobytes() for x in made], pa.binary()),
            ], ["id", "n", "starts", "bases", "slopes", "residuals"])

    if not 0 < error <= ERROR:
        raise ValueError(f"error must be from 1 to {ERROR}: residuals are single bytes")
    narrow = documents.select(quoted(id_column).cast("long").alias("id"), quoted(text_column).alias("text"))
    kind = "id long, n long, starts array<long>, bases array<long>, slopes array<double>, residuals binary"
    return narrow.mapInArrow(run, kind).withColumnRenamed("id", id_column)
