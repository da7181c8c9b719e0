"""A small autoencoder trained by full-batch gradient descent over the cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from logharbor.functions.stats import exact_quantiles
from logharbor.functions.vectors import distinct_vectors, summed_over, weighted_moments
from logharbor.operators.bundle import load_bundle, save_bundle
from logharbor.session import durable

_FITTED = ("mean", "sigma", "w_in", "b_in", "w_out", "b_out")

FEATURES = ("message_length", "severity_score", "hour", "day_of_week", "word_count", "char_diversity")


class Autoencoder:
    """Rows that are rebuilt badly are anomalies; the cut is a quantile of the error."""

    def __init__(
        self, features: Sequence[str] = FEATURES, epochs: int = 50, learning_rate: float = 0.01,
        quantile: float = 0.95, seed: int = 42,
    ) -> None:
        self.features = list(features)
        self.epochs, self.learning_rate = epochs, learning_rate
        self.quantile, self.seed = quantile, seed
        self.threshold: float | None = None
        self.losses: list[float] = []

    def _forward(self, scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(scaled @ self.w_in + self.b_in, 0.0)
        return hidden, hidden @ self.w_out + self.b_out

    def fit(self, df: DataFrame) -> "Autoencoder":
        data = durable(distinct_vectors(df, self.features))
        self.mean, self.sigma = weighted_moments(data, self.features)
        d = len(self.features)
        h = max(2, d // 2)
        rng = np.random.default_rng(self.seed)
        self.w_in = rng.normal(size=(d, h)) * np.sqrt(2.0 / d)
        self.w_out = rng.normal(size=(h, d)) * np.sqrt(2.0 / h)
        self.b_in, self.b_out = np.zeros(h), np.zeros(d)
        size = 2 * d * h + h + d + 2

        def gradients(points: np.ndarray, weight: np.ndarray) -> np.ndarray:
            x = (points - self.mean) / self.sigma
            hidden, rebuilt = self._forward(x)
            error = rebuilt - x
            back = 2.0 * error * weight[:, None]
            inner = (back @ self.w_out.T) * (hidden > 0)
            return np.concatenate([
                (x.T @ inner).ravel(), inner.sum(axis=0), (hidden.T @ back).ravel(), back.sum(axis=0),
                [weight @ (error ** 2).mean(axis=1), weight.sum()],
            ])

        for _ in range(self.epochs):
            total = summed_over(data, self.features, size, gradients)
            n = max(total[-1], 1.0)
            self.losses.append(total[-2] / n)
            step = self.learning_rate * total / n
            a, b, c = d * h, d * h + h, 2 * d * h + h
            self.w_in = self.w_in - step[:a].reshape(d, h)
            self.b_in = self.b_in - step[a:b]
            self.w_out = self.w_out - step[b:c].reshape(h, d)
            self.b_out = self.b_out - step[c:c + d]
        self.threshold = exact_quantiles(
            self.scored(df), "reconstruction_error", [self.quantile], costly=True
        )[0]
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        about = {n: getattr(self, n) for n in ("features", "epochs", "learning_rate", "quantile", "seed", "threshold", "losses")}
        save_bundle(spark, path, "autoencoder", about, {n: getattr(self, n) for n in _FITTED})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Autoencoder":
        about, arrays, _ = load_bundle(spark, path, "autoencoder")
        threshold, losses = about.pop("threshold"), about.pop("losses")
        model = cls(**about)
        model.threshold, model.losses = threshold, losses
        for name in _FITTED:
            setattr(model, name, arrays[name])
        return model

    def scored(self, df: DataFrame) -> DataFrame:
        state = self

        @F.pandas_udf("double")
        def error(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
                x = (points - state.mean) / state.sigma
                yield pd.Series(((state._forward(x)[1] - x) ** 2).mean(axis=1))

        inputs = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features]
        return df.withColumn("reconstruction_error", error(*inputs))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.threshold is None:
            raise ValueError("fit the detector first")
        rows = self.scored(df)
        return rows.withColumn(
            "anomaly_score", F.col("reconstruction_error") / F.lit(self.threshold)
        ).withColumn("is_anomaly", (F.col("reconstruction_error") > F.lit(self.threshold)).cast("int"))

    def feature_importance(self) -> dict[str, float]:
        """Mean absolute weights of a feature in both layers, summing to one."""
        weight = (np.abs(self.w_in).mean(axis=1) + np.abs(self.w_out).mean(axis=0)) / 2.0
        return dict(zip(self.features, (weight / weight.sum()).tolist()))
