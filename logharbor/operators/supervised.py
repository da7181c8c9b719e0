"""Supervised detectors on spark.ml: heuristic labels, forests, tuning, feedback."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession, functions as F

from logharbor import constants as K
from logharbor.functions import text as X
from logharbor.functions.stats import kth_smallest
from logharbor.operators.bundle import load_bundle, save_bundle
from logharbor.operators.features import with_error_keywords
from logharbor.operators.scoring import importance_table
from logharbor.operators.tfidf import tokens
from logharbor.session import durable, shared_dir, spread

#: Rows that a task keeps as vectors while trees are grown; a vector of 500 terms takes about 2.5 kB.
_ROWS_PER_TASK = 250_000


def heuristic_labels(
    df: DataFrame, contamination: float = 0.1, key: tuple[str, ...] = ("line_number",)
) -> DataFrame:
    """``label`` 1 for error levels, over-long messages and telling keywords.

    If that marks more than the given share, a pseudo-random part of it is kept: the rows
    with the smallest hashes of their key, cut at an exact order statistic, so that no
    global ranking is needed.
    """
    length = F.coalesce(F.length("message"), F.lit(0))
    lowered = F.lower(F.coalesce(F.col("message"), F.lit("")))
    limits = df.agg(
        F.count(F.lit(1)).alias("n"), F.percentile(length.cast("double"), F.lit(0.95)).alias("p95")
    ).first()
    raw = (
        F.col("level").isin("ERROR", "WARN")
        | (length > F.lit(limits["p95"]))
        | X.contains_any(lowered, K.LABEL_KEYWORDS)
    )
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    # 13 hexadecimal digits fit a double exactly.
    rank = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    rows = df.withColumn("label", F.coalesce(raw, F.lit(False)).cast("int")).withColumn("_hash", rank)
    positives = rows.where(F.col("label") == 1)
    marked, keep = positives.count(), int(limits["n"] * contamination)
    if marked > limits["n"] * contamination:
        limit = kth_smallest(positives, "_hash", keep) if keep else -1.0
        rows = rows.withColumn(
            "label", ((F.col("label") == 1) & (F.col("_hash") <= F.lit(limit))).cast("int")
        )
    return rows.drop("_hash")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight n / (classes * rows of the class)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn("weight", weight)


def _stored(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model written to shared storage and read back: without its training state (summary,
    estimator), so that only the trees travel with the scoring plan, and kept for a restart."""
    path = shared_dir(spark, "model")
    model.write().save(path)
    return PipelineModel.load(path)


class RandomForestDetector:
    """Random forest trained on heuristic labels; the score is the anomaly probability."""

    def __init__(
        self, n_estimators: int = 100, contamination: float = 0.1, terms: int = 500,
        max_depth: int = 10, seed: int = 42,
    ) -> None:
        self.n_estimators = n_estimators
        self.contamination = contamination
        self.terms = terms
        self.max_depth = max_depth
        self.seed = seed
        self.model: PipelineModel | None = None

    @property
    def numeric(self) -> list[str]:
        return ["message_length", "level_value", *[f"has_{k}" for k in K.ERROR_KEYWORDS]]

    def features(self, df: DataFrame) -> DataFrame:
        return with_error_keywords(df).select(
            "*",
            X.char_length(F.col("message")).alias("message_length"),
            X.severity(F.col("level"), "four_level").alias("level_value"),
            tokens(F.coalesce("message", F.lit(""))).alias("_tokens"),
        )

    def fit(self, df: DataFrame) -> "RandomForestDetector":
        rows = balanced_weights(heuristic_labels(self.features(df), self.contamination))
        # The stages read the rows again and again: keep what they need.
        rows = durable(rows.select("_tokens", *self.numeric, "label", "weight"))
        counter = CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=self.terms).fit(rows)
        idf = IDF(inputCol="_tf", outputCol="_raw").fit(counter.transform(rows)).idf.toArray()
        fixed = [
            counter,
            # A term that is in every row keeps the weight of its count: idf + 1, then unit length.
            ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol="_tf", outputCol="_raw"),
            Normalizer(inputCol="_raw", outputCol="_tfidf"),
            VectorAssembler(inputCols=[*self.numeric, "_tfidf"], outputCol="_features"),
        ]
        forest = RandomForestClassifier(
            featuresCol="_features", labelCol="label", weightCol="weight",
            numTrees=self.n_estimators, maxDepth=self.max_depth, seed=self.seed,
        )
        trees = forest.fit(PipelineModel(fixed).transform(spread(rows, _ROWS_PER_TASK)))
        self.model = _stored(PipelineModel([*fixed, trees]), df.sparkSession)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit the detector first")
        scored = self.model.transform(self.features(df))
        return scored.select(
            *df.columns,
            vector_to_array("probability")[1].alias("anomaly_score"),
            F.col("prediction").cast("int").alias("is_anomaly"),
        )

    def feature_importance(self) -> dict[str, float]:
        if self.model is None:
            return {}
        words = self.model.stages[0].vocabulary
        names = [*self.numeric, *[f"text_{w}" for w in words]]
        return dict(zip(names, (float(v) for v in self.model.stages[-1].featureImportances.toArray())))

    def importance_table(self, spark: SparkSession) -> DataFrame:
        return importance_table(spark, {"random_forest": self}).select("feature", "importance")

    def save(self, path: str) -> None:
        if self.model is None:
            raise ValueError("fit the detector first")
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> "RandomForestDetector":
        self.model = PipelineModel.load(path)
        return self


class GradientBoostingSearch:
    """Random search over boosted trees, three folds, F1 of the positive class."""

    def __init__(
        self, features: list[str], label: str, trials: int = 100, folds: int = 3, seed: int = 42,
        estimators: tuple[int, int] = (50, 500), depth: tuple[int, int] = (3, 20),
        rate: tuple[float, float] = (0.01, 0.3), subsample: tuple[float, float] = (0.5, 1.0),
    ) -> None:
        self.features, self.label = list(features), label
        self.trials, self.folds, self.seed = trials, folds, seed
        self.space = {"maxIter": estimators, "maxDepth": depth, "stepSize": rate, "subsamplingRate": subsample}
        self.best_model = None
        self.best_params: dict[str, float] = {}
        self.history: list[tuple[int, float, str]] = []

    def fit(self, df: DataFrame, parallelism: int = 4) -> "GradientBoostingSearch":
        # Trials times folds times rounds of passes follow.
        kept = durable(df.select(*self.features, self.label))
        data = VectorAssembler(inputCols=self.features, outputCol="_features").transform(spread(kept, _ROWS_PER_TASK))
        booster = GBTClassifier(featuresCol="_features", labelCol=self.label, seed=self.seed)
        chooser = random.Random(self.seed)
        grids, drawn = [], []
        for _ in range(self.trials):
            values = {
                name: chooser.randint(lo, hi) if isinstance(lo, int) else chooser.uniform(lo, hi)
                for name, (lo, hi) in self.space.items()
            }
            drawn.append(values)
            grids.append({booster.getParam(name): value for name, value in values.items()})
        judge = MulticlassClassificationEvaluator(
            labelCol=self.label, metricName="fMeasureByLabel", metricLabel=1.0
        )
        search = CrossValidator(
            estimator=booster, estimatorParamMaps=grids, evaluator=judge, numFolds=self.folds,
            seed=self.seed, parallelism=parallelism,
        )
        result = search.fit(data)
        scores = list(result.avgMetrics)
        self.best_model = result.bestModel
        self.best_params = drawn[scores.index(max(scores))]
        self.history = [(i, float(s), str(p)) for i, (s, p) in enumerate(zip(scores, drawn))]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        data = VectorAssembler(inputCols=self.features, outputCol="_features").transform(df)
        scored = self.best_model.transform(data)
        return scored.select(
            *df.columns,
            vector_to_array("probability")[1].alias("anomaly_score"),
            F.col("prediction").cast("int").alias("is_anomaly"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        if self.best_model is None:
            raise ValueError("fit the search first")
        about = {"features": self.features, "label": self.label, "best_params": self.best_params, "history": self.history}
        save_bundle(spark, path, "boosted_trees", about)
        self.best_model.write().overwrite().save(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "GradientBoostingSearch":
        about, _, _ = load_bundle(spark, path, "boosted_trees")
        search = cls(about["features"], about["label"])
        search.best_params, search.history = about["best_params"], [tuple(h) for h in about["history"]]
        search.best_model = GBTClassificationModel.load(f"{path}/model")
        return search


def refit_with_feedback(
    df: DataFrame, feedback: DataFrame, features: list[str], key: list[str],
    min_samples: int = 100, trees: int = 50, seed: int = 42,
) -> PipelineModel | None:
    """Learn from checked predictions: ``feedback`` holds key, ``prediction`` and ``correct``.

    A wrong prediction counts as the opposite label. Nothing is learned before
    ``min_samples`` rows have been checked.
    """
    if feedback.limit(min_samples).count() < min_samples:
        return None
    truth = F.when(F.col("correct"), F.col("prediction")).otherwise(1 - F.col("prediction"))
    rows = df.join(feedback.select(*key, truth.cast("int").alias("label")), key)
    stages = [
        VectorAssembler(inputCols=features, outputCol="_features"),
        RandomForestClassifier(
            featuresCol="_features", labelCol="label", weightCol="weight", numTrees=trees, seed=seed
        ),
    ]
    return _stored(Pipeline(stages=stages).fit(balanced_weights(rows)), df.sparkSession)
