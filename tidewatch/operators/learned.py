"""Learned scorers: boosted trees over features, and texts by word pairs, with the rules as the fallback."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(p: Column, critical: float = 0.9, high: float = 0.75, medium: float = 0.5) -> Column:
    return F.when(p >= critical, "critical").when(p >= high, "high").when(p >= medium, "medium").otherwise("low")


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight: the rarer label counts as much as the other."""
    n = rows.agg(F.sum(label).alias("pos"), F.count("*").alias("n")).first()
    pos = max(1, n["pos"] or 0)
    return rows.withColumn("weight", F.when(F.col(label) == 1, (n["n"] - pos) / pos).otherwise(1.0))


def fit_features(rows: DataFrame, names: list[str], label: str = "label", rounds: int = 10) -> PipelineModel:
    """Boosted trees over numeric features; MLlib aggregates their histograms on the executors."""
    stages = [VectorAssembler(inputCols=names, outputCol="vector"), GBTClassifier(featuresCol="vector", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=4, stepSize=0.2, seed=42)]
    return Pipeline(stages=stages).fit(weighted(rows.na.fill(0, names), label))


def score_features(rows: DataFrame, model: PipelineModel | None, names: list[str], threshold: float = 0.7) -> DataFrame:
    """rows (with the rules' score and signal_kind) with the model's; without a model the rules stand."""
    if model is None:
        return rows
    p = F.round(vector_to_array("probability")[1], 6)
    out = model.transform(rows.na.fill(0, names))
    return out.withColumns({"rule_score": F.col("score"), "score": p, "severity": band(p), "signal_kind": F.when(p >= threshold, F.col("signal_kind"))}).drop("vector", "rawPrediction", "probability", "prediction")


def fit_text(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14) -> PipelineModel:
    """Words and word pairs, hashed, their counts weighted by inverse document frequencies, into a logistic regression."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"\W+"), NGram(n=2, inputCol="w1", outputCol="w2"), SQLTransformer(statement="select *, concat(w1, w2) as terms from __THIS__"),
        HashingTF(inputCol="terms", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="vector"), LogisticRegression(featuresCol="vector", labelCol=label, weightCol="weight", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(weighted(rows, label))


def score_text(rows: DataFrame, model: PipelineModel, rules: str = "rule_score") -> DataFrame:
    """rows with score: the rules' where it is 0.7 or more, else the model's."""
    p = F.round(vector_to_array("probability")[1], 6)
    out = model.transform(rows).withColumn("score", F.when(F.col(rules) >= 0.7, F.col(rules)).otherwise(p))
    return out.withColumn("severity", band(F.col("score"), 0.9, 0.7, 0.5)).drop("w1", "w2", "terms", "tf", "vector", "rawPrediction", "probability", "prediction")
