"""Grouped cross-validation of boosted trees on pair features."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kinlink.operators import metrics
from kinlink.operators.features import FEATURES
from kinlink.scratch import materialise

#: Most trees of a model, and pairs of a task in training.
TREES, ROWS_PER_TASK = 1000, 100_000


def _bucket(column: str, of: int):
    """A number below `of` from the text's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(of))


def group_folds(pairs: DataFrame, k: int = 5) -> DataFrame:
    """s1_id, fold: groups dealt out in turn by size, so all pairs of a record share a fold and folds are even. Sizes are
    ranked within hash buckets, not in one window over all groups."""
    size = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    bucket = _bucket("s1_id", 1024)
    place = F.row_number().over(W.partitionBy(bucket).orderBy(F.desc("n"), "s1_id"))
    return size.select("s1_id", F.pmod(place + bucket - 1, F.lit(k)).cast("int").alias("fold"))


def balanced(train: DataFrame) -> DataFrame:
    """train with `weight`: negatives per positive for positives, else 1."""
    w = metrics.class_balance(train).first().weight
    return train.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(w or 1.0))).otherwise(1.0))


def classifier(seed: int, trees: int = TREES, validation: str | None = None) -> Pipeline:
    """Boosted trees; with a validation column, boosting ends when a tree lowers the loss on those rows by less than a hundredth (or 0.0001)."""
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, stepSize=0.05, maxDepth=6, minInstancesPerNode=20, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    if validation:
        gbt = gbt.setParams(validationIndicatorCol=validation, validationTol=0.01)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), gbt])


def score_pairs(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """pairs with `score`, the probability of a match."""
    return model.transform(pairs).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _validation_share(train: DataFrame) -> int | None:
    """Hundredths of the groups, the least of a few, such that they and the rest hold both classes."""
    kinds = train.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).collect()  # a row for each of 100 buckets
    for share in (10, 20, 30, 50):
        parts = [r for r in kinds if r.bucket < share], [r for r in kinds if r.bucket >= share]
        if all(p and min(r.low for r in p) < max(r.high for r in p) for p in parts):
            return share
    return None


def train_folds(pairs: DataFrame, k: int = 5, trees: int = TREES, seed: int = 42, early_stop: bool = True) -> tuple[list[PipelineModel], DataFrame]:
    """One model per fold, and every pair scored by the model that did not see it. A tenth of the training groups of each
    fold, by hash (more where a tenth lacks a class), decides when boosting ends; the fold itself is never looked at."""
    rows = pairs.join(group_folds(pairs, k), "s1_id").withColumn("label", F.col("label").cast("double"))
    rows = materialise(rows.withColumn("bucket", _bucket("s1_id", 100)), "pairs")
    # Each tree is a few jobs over the pairs; on small tables tasks of few rows would cost more than they do.
    rows = rows.coalesce(max(1, -(-rows.count() // ROWS_PER_TASK)))
    models, scored = [], []
    for fold in range(k):
        train = balanced(rows.where(F.col("fold") != fold)).persist(StorageLevel.MEMORY_AND_DISK)
        share = _validation_share(train) if early_stop else None
        model = classifier(seed + fold, trees, "validation" if share else None).fit(train.withColumn("validation", F.col("bucket") < (share or 0)))
        train.unpersist()
        models.append(model)
        scored.append(score_pairs(model, rows.where(F.col("fold") == fold)))
    return models, reduce(DataFrame.unionByName, scored).drop("bucket").withColumn("label", F.col("label").cast("int"))


def best_iterations(models: list[PipelineModel]) -> list[int]:
    """Trees that each fold's model kept."""
    return [m.stages[-1].getNumTrees for m in models]


def ensemble(models: list[PipelineModel], pairs: DataFrame) -> DataFrame:
    """pairs with the mean probability over models; each model adds a column, so pairs are read once."""
    rows = pairs
    for i, m in enumerate(models):
        rows = score_pairs(m, rows).withColumnRenamed("score", f"_s{i}")
    mean = reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in range(len(models))]) / len(models)
    return rows.withColumn("score", mean).drop(*[f"_s{i}" for i in range(len(models))])


def importances(spark: SparkSession, models: list[PipelineModel]) -> DataFrame:
    """feature, importance: means over the models."""
    each = [m.stages[-1].featureImportances.toArray() for m in models]
    mean = [float(x) for x in sum(each) / len(each)]
    return spark.createDataFrame(list(zip(FEATURES, mean)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(models: list[PipelineModel], path: str) -> None:
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/fold_{i}")


def load(path: str, k: int = 5) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/fold_{i}") for i in range(k)]


def decide(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs at or over the threshold."""
    return pairs.where(F.col("score") >= F.lit(threshold))
