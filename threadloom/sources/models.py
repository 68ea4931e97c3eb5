"""Fitted tag classifiers on storage: features, classifier and class names belong together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import search_tokens
from threadloom.operators.models import predicted_tags, with_probabilities


@dataclass(frozen=True)
class TagModel:
    """What it takes to predict the tags of a raw question."""

    features: PipelineModel
    classifier: OneVsRestModel
    classes: tuple[str, ...]

    def predict(self, questions: DataFrame, text: str = "question", tokens: str = "tokens") -> DataFrame:
        """``questions`` with ``predicted``: the most probable (tag, score) of each raw text."""
        split = questions.withColumn(tokens, search_tokens(F.col(text)))
        scored = with_probabilities(self.classifier, self.features.transform(split))
        return predicted_tags(scored, self.classes).select(*questions.columns, "predicted")


def save_tag_model(model: TagModel, spark: SparkSession, path: str) -> None:
    model.features.write().overwrite().save(f"{path}/features")
    model.classifier.write().overwrite().save(f"{path}/classifier")
    names = spark.createDataFrame(list(enumerate(model.classes)), "label int, name string")
    names.write.mode("overwrite").parquet(f"{path}/classes")


def load_tag_model(spark: SparkSession, path: str) -> TagModel:
    names = spark.read.parquet(f"{path}/classes").orderBy("label").collect()  # one row per class
    features, classifier = PipelineModel.load(f"{path}/features"), OneVsRestModel.load(f"{path}/classifier")
    return TagModel(features, classifier, tuple(r["name"] for r in names))
