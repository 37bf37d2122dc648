"""The only state a learner keeps on the driver: one number per feature."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gapwise.functions.linear import linear_score, score_text


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float = 0.0
    info: dict = field(default_factory=dict, compare=False)

    def score(self, skip_null: bool = False, with_intercept: bool = True):
        return linear_score(self.features, self.weights,
                            self.intercept if with_intercept else 0.0, skip_null)

    def text(self, skip_null: bool = False, with_intercept: bool = True) -> str:
        return score_text(self.features, self.weights,
                          self.intercept if with_intercept else 0.0, skip_null)

    def weight(self, feature: str) -> float:
        return self.weights[self.features.index(feature)]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.score())

    def as_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(w)) for f, w in zip(self.features, self.weights)]
        return spark.createDataFrame(rows + [("intercept", float(self.intercept))],
                                     "feature string, weight double")
