"""Text quality: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every text gives two dozen statistics (sizes, shares of kinds of characters, repetition, entropy).
Random cosines of the standardised statistics approximate a Gaussian kernel. Each partition of the
training rows sums its part of the normal equations, the driver adds the sums (their number and size
are parameters), and one ridge solution comes out. Rows kept aside from it calibrate the scores:
their counts in fixed bins are pooled until the share of good texts rises with the score.

Statistics of all texts are written once; fitting and scoring read those, never the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import buffers, fresh, kept, lean, stretches, texts, word_bounds, word_numbers

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "line": b"\n",
    "stop": b".?;:",
    "comma": b",'\"-",
    "shout": b"!",
    "bar": b"|",
    "sign": b"#$%&*~^<>=+@_/\\{}[]()`",
    "wide": bytes(range(128, 256)),
}
STATISTICS = (
    *(f"share_{kind}" for kind in _KINDS),
    "log_bytes",
    "log_words",
    "word_length",
    "word_spread",
    "longest_word",
    "line_words",
    "repeats",
    "variety",
    "entropy",
    "caps_words",
)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros throughout."""
    n = len(at) - 1
    sizes = np.diff(at)
    text = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256)
    share = counts / np.maximum(sizes, 1)[:, None]
    starts, ends, words = word_bounds(data, at)
    lengths = (ends - starts).astype(float)
    some = np.maximum(words, 1)
    first = np.concatenate(([0], np.cumsum(words)))
    total = lambda values: np.add.reduceat(np.append(values, 0.0), first[:-1]) * (words > 0)
    mean = total(lengths) / some
    spread = np.sqrt(np.maximum(total(lengths**2) / some - mean**2, 0))
    longest = np.maximum.reduceat(np.append(lengths, 0.0), first[:-1]) * (words > 0) if n else np.zeros(0)
    number = word_numbers(data, starts, ends)
    owner = np.repeat(np.arange(n), words)
    same = np.zeros(len(number))
    same[1:] = (number[1:] == number[:-1]) & (owner[1:] == owner[:-1])
    seen = np.bincount(owner * 512 + (number >> np.uint64(55)).astype(np.int64), minlength=n * 512).reshape(n, 512)
    capital = (data[starts] >= 65) & (data[starts] <= 90) if len(starts) else np.zeros(0, bool)
    second = np.minimum(starts + 1, max(len(data) - 1, 0))
    capital = capital & (data[second] >= 65) & (data[second] <= 90) if len(starts) else capital
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    lines = share[:, 10] * sizes + 1
    columns = [
        *(share[:, list(letters)].sum(axis=1) for letters in _KINDS.values()),
        np.log1p(sizes),
        np.log1p(words),
        mean,
        spread,
        np.log1p(longest),
        np.log1p(words / lines),
        total(same) / some,
        (seen > 0).sum(axis=1) / (512 * -np.expm1(-some / 512)),
        entropy,
        total(capital.astype(float)) / some,
    ]
    return np.stack(columns, axis=1) * (sizes > 0)[:, None] if n else np.zeros((0, len(STATISTICS)))


def _measured(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    runs = [statistics(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in stretches(at)]
    return np.concatenate([np.zeros((0, len(STATISTICS))), *runs])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = _measured(*buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), _vectors(values)], names=["doc_id", "statistics"]
        )


def _vectors(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass
class QualityModel:
    """Centre and scale of the statistics, random directions, ridge weights, calibration curve."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def cosines(self, values: np.ndarray) -> np.ndarray:
        x = np.clip((values - self.centre) / self.scale, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)

    def raw(self, values: np.ndarray) -> np.ndarray:
        return self.cosines(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(values), *self.curve), 0, 1)


def pooled(good: np.ndarray, count: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic shares of good rows: neighbouring bins are pooled while the share falls; the curve goes
    through the mean score of each pool."""
    pools: list[list[float]] = []
    for g, c, m in zip(good, count, middle):
        if c:
            pools.append([g, c, m * c])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                g2, c2, m2 = pools.pop()
                pools[-1] = [pools[-1][0] + g2, pools[-1][1] + c2, pools[-1][2] + m2]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    # One good and one bad row are spread over the rim pools, so no score claims certainty.
    x = np.array([m / c for _, c, m in pools])
    y = np.array([(g + 0.5) / (c + 1) for g, c, _ in pools])
    return x, np.maximum.accumulate(y)


def fit(
    measured: DataFrame,
    labels: DataFrame,
    features: int = 384,
    width: float = 1.0,
    ridge: float = 1e-3,
    fit_rows: int = 200_000,
    parts: int = 24,
    bins: int = 2000,
    seed: int = 5,
) -> QualityModel | None:
    """A model from labelled rows that are not held out; None where there is none.

    ``fit_rows`` bounds the labelled rows used, picked by a hash of their ids; ``parts`` is the number
    of partial sums. A fifth of the rows used calibrates and takes no part in the solution. Of repeated
    labels of an id the mean decides; null labels are left out.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("labelled")).agg(
        (F.avg("quality") >= 0.5).cast("double").alias("good")
    )
    rows = measured.join(known.where(~is_held_out(F.col("labelled"))), F.col("doc_id") == F.col("labelled")).select(
        "doc_id", "statistics", "good", F.xxhash64(F.lit(seed), "doc_id").alias("draw")
    )
    rows = kept(rows, "labelled")
    count = rows.count()
    if not count:
        return None
    if count > fit_rows:
        rows = rows.where(F.pmod("draw", F.lit(1 << 40)) < int((1 << 40) * fit_rows / count))
    size = len(STATISTICS)
    sums = rows.agg(
        *(F.avg(F.col("statistics")[i]).alias(f"a{i}") for i in range(size)),
        *(F.stddev_pop(F.col("statistics")[i]).alias(f"s{i}") for i in range(size)),
    ).head()
    rng = np.random.default_rng(seed)
    model = QualityModel(
        np.array([sums[f"a{i}"] for i in range(size)]),
        np.maximum(np.array([sums[f"s{i}"] for i in range(size)]), 1e-6),
        rng.normal(0, 1 / (width * np.sqrt(size)), (size, features)),
        rng.uniform(0, 2 * np.pi, features),
        np.zeros(features + 1),
        (np.array([0.0, 1.0]), np.array([0.0, 1.0])),
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for batch in batches:
            z, y = model.cosines(_matrix(batch.column("statistics"), size)), np.asarray(batch.column("good"))
            left += z.T @ z
            right += z.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array([left.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["a", "b"]
        )

    calibrates = F.pmod(F.shiftrightunsigned("draw", 41), F.lit(5)) == 0
    left, right = ridge * count * np.eye(features + 1) / features, np.zeros(features + 1)
    left[-1, -1] = 1e-9
    for part in rows.where(~calibrates).coalesce(parts).mapInArrow(lean(add), "a binary, b binary").toLocalIterator():
        left += np.frombuffer(part["a"]).reshape(left.shape)
        right += np.frombuffer(part["b"])
    model.weights = np.linalg.solve(left, right)

    def bin_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.raw(_matrix(batch.column("statistics"), size)), -0.5, 1.5)
            place = np.minimum(((raw + 0.5) / 2 * bins).astype(np.int32), bins - 1)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("good")], names=["bin", "good"])

    found = rows.where(calibrates).mapInArrow(lean(bin_of), "bin int, good double").groupBy("bin").agg(F.sum("good").alias("good"), F.count("*").alias("n"))
    good, n = np.zeros(bins), np.zeros(bins)
    for row in found.collect():  # at most ``bins`` rows
        good[row["bin"]], n[row["bin"]] = row["good"], row["n"]
    model.curve = pooled(good, n, (np.arange(bins) + 0.5) / bins * 2 - 0.5)
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; null and empty texts too.

    Labels, language, source and id are no inputs of a score. Repeated rows get a row each; a null id
    is not held out. Without any usable label every score is 0.5.
    """
    measured = kept(texts(docs).mapInArrow(lean(_measure), "doc_id long, statistics array<double>"), "statistics")
    model = fit(measured, labels, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("statistics"), len(STATISTICS))
            scores = model.score(values) if model else np.full(len(values), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return measured.mapInArrow(lean(apply), "doc_id long, score double").select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject; no row moves for that."""
    model = fit(kept(texts(docs).mapInArrow(lean(_measure), "doc_id long, statistics array<double>"), "statistics"), labels, **options)
    if model is None:
        return docs
    last = len(docs.columns)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffers(batch.column(last))
            yield batch.filter(pa.array(model.score(_measured(data, at)) >= threshold)).select(range(last))

    return docs.select("*", F.coalesce("text", F.lit("")).alias(fresh(docs, "whole_text")[0])).mapInArrow(lean(choose), docs.schema)
